"""The engine on small tables made for it: planted rules, three-valued logic, lifecycle, identity, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rulewright.functions.identity import condition_json, rule_id
from rulewright.functions.logic import CONDITION, all_of, unknown_facts
from rulewright.operators import advise, evaluate, observe, patterns, recommend, store
from rulewright.operators.instances import as_of, instances
from rulewright.operators.typing import classify, one_episode, scope_by
from rulewright.plans.mine import mine, statistics
from rulewright.schema import Thresholds, alphabet
from rulewright.sources import logs, written

EVENTS = "interaction string, episode string, seq int, at long, kind string, type string, slots map<string,string>, text string, operator string, team string, agent string"


def events(spark, contacts, operator="op"):
    """contacts: {interaction: [(episode, type, slots)]}"""
    rows = [(c, f"{c}#{e}", k, k, "action", t, s, None, operator, "team", "agent") for c, steps in contacts.items() for k, (e, t, s) in enumerate(steps)]
    return spark.createDataFrame(rows, EVENTS)


@pytest.fixture(scope="module")
def terms(spark):
    return alphabet(
        spark,
        [
            {"type": "action:refund", "consequence": "irreversible", "recommendable": True},
            {"type": "action:verify", "consequence": "none"},
            {"type": "action:lookup", "consequence": "none"},
            {"type": "action:edit", "consequence": "compensable", "identity": ["file"]},
            {"type": "action:read", "consequence": "none", "identity": ["file"]},
            {"type": "action:write", "consequence": "none", "identity": ["file"]},
        ],
    )


def test_window_of_the_contact(spark, terms):
    contacts = {}
    for k in range(1, 11):
        first = [(0, "action:verify", {})] + ([(0, "action:lookup", {})] if k <= 7 else [])
        contacts[f"wnd-{k:04d}"] = first + [(1, "action:refund", {})] + ([] if k <= 7 else [(1, "action:lookup", {})])
    rules = {(r["pattern"], tuple(r["guards"])): r for r in mine(events(spark, contacts), terms).collect()}
    assert not [k for k in rules if k[0] == patterns.IMPLIES]
    sure = rules[patterns.WITHOUT, ("action:verify",)]
    assert (sure["holds"], sure["of"], sure["status"]) == (10, 10, "suppressed")
    open_ = rules[patterns.WITHOUT, ("action:lookup",)]
    assert (open_["holds"], open_["of"], open_["status"], open_["failing"]) == (7, 10, "proposed", "wnd-0008")
    assert "kept in 7 of 10 cases" in open_["evidence"]


def test_same_slot(spark, terms):
    reader = {f"r{k}": [(0, "action:read", {"file": f"f{k}"}), (1, "action:edit", {"file": f"f{k}"})] for k in range(6)} | {"r9": [(0, "action:read", {"file": "other"}), (1, "action:edit", {"file": "f9"})]}
    writer = {f"w{k}": [(0, "action:write", {"file": f"g{k}"}), (1, "action:edit", {"file": f"g{k}"})] for k in range(6)}
    both = events(spark, reader, "reader").unionByName(events(spark, writer, "writer"))
    rules = [r for r in mine(both, terms).collect() if r["pattern"] == patterns.SAME]
    assert {(r["operator"], "|".join(r["guards"]), r["holds"], r["of"]) for r in rules} == {("reader", "action:read|action:write", 6, 7), ("writer", "action:read|action:write", 6, 6)}
    assert statistics(mine(both, terms)).where("operator is null").count() == 1


def test_mining_is_the_same_whatever_the_partitions(spark, terms):
    contacts = {f"c{k}": [(0, "action:verify", {}), (0, "action:refund", {})] + [(1, "action:refund", {})] * (k % 3) for k in range(12)}
    def found(n):
        return sorted(map(str, mine(events(spark, contacts).repartition(n), terms, Thresholds(own_support=0.3)).drop("suppressed_by").collect()))

    assert found(1) == found(7)


def test_three_values(spark):
    rows = spark.createDataFrame([({"a": "1"},), ({"a": "2"},), ({"b": "1"},), ({"a": "1", "b": "x"},)], "facts map<string,string>")
    two = F.expr(f"cast(array(named_struct('fact','a','op','eq','values',array('1')), named_struct('fact','b','op','neq','values',array('y'))) as array<{CONDITION}>)")
    got = [tuple(r) for r in rows.select(all_of(two, F.col("facts")), unknown_facts(two, F.col("facts"))).collect()]
    assert got == [(None, ["b"]), (False, []), (None, ["a"]), (True, [])]


def test_identity(spark):
    c = condition_json(F.lit("obs.states_double_charge"), F.lit("eq"), F.lit("true"))
    one = spark.range(1).select(rule_id(F.lit("recommendation"), F.lit("antecedent-implies-action"), {"action": F.lit("action:escalate")}, F.array(c), F.lit("episode")).alias("id"))
    assert one.first()["id"] == "2f663a4cec907cc9"


def test_as_of(spark):
    sites = spark.createDataFrame([("e", 0), ("e", 1), ("e", 2), ("e", 3), ("f", 5)], "episode string, seq int")
    seen = spark.createDataFrame([("e", 0, "obs.x", "true"), ("e", 1, "obs.x", None), ("e", 2, "obs.x", "false")], "episode string, seq int, fact string, value string")
    got = {(r["episode"], r["seq"]): r["value"] for r in as_of(sites, seen, ["episode"], ["seq"]).collect()}
    assert got == {("e", 0): None, ("e", 1): "true", ("e", 2): "true", ("e", 3): "false", ("f", 5): None}


def test_lifecycle(spark):
    cols = "id string, corpus string, scope string, holds long, of long, status string"
    stored = [("a", "real", 9, 10), ("b", "not_real", 9, 10), ("c", "not_real", 9, 10), ("d", "retired", 9, 10), ("e", "proposed", 9, 10), ("f", "refused", 1, 10), ("g", "real", 9, 10), ("h", "narrowed", 9, 10)]
    mined = [("a", "proposed", 2, 3), ("b", "proposed", 5, 10), ("c", "proposed", 9, 10), ("d", "proposed", 9, 10), ("g", "proposed", 8, 10), ("i", "refused", 1, 9), ("h", "proposed", 9, 10)]
    old = spark.createDataFrame([(i, "x", "s", h, o, s) for i, s, h, o in stored], cols).withColumn("reason", F.lit(None).cast("string"))
    new = spark.createDataFrame([(i, "x", "s", h, o, s) for i, s, h, o in mined], cols)
    got = {r["id"]: (r["status"], r["change"]) for r in store.merge(old, new, "r").collect()}
    assert got == {
        "a": ("retired", "retired"), "b": ("proposed", "reproposed"), "c": ("not_real", "kept"), "d": ("proposed", "reproposed"), "e": ("retired", "retired"),
        "f": ("refused", "removed"), "g": ("real", "kept"), "h": ("narrowed", "kept"), "i": ("refused", "inserted"),
    }


def test_adjudication(spark):
    rules = spark.createDataFrame([("a", "s", "proposed", [("obs.x", "eq", ["true"])]), ("b", "s", "proposed", [])], f"id string, scope string, status string, conditions array<{CONDITION}>")
    said = spark.createDataFrame([("a", "s", "real", 1), ("b", "s", "not_real", 1), ("b", "s", "real", 2)], "id string, scope string, verdict string, at int")
    none = spark.createDataFrame([], "fact string")
    got = {r["id"]: (r["status"], r["refusal"] is not None) for r in store.adjudicate(rules, said, none).collect()}
    assert got == {"a": ("proposed", True), "b": ("real", False)}


def requests(spark, rows):
    return spark.createDataFrame(rows, advise.REQUESTS)


OBLIGATION = f"operator string, id string, pattern string, subject string, guards array<string>, slot string, conditions array<{CONDITION}>"
HINT = f"operator string, id string, action string, conditions array<{CONDITION}>"


def test_advice(spark):
    slots = [{"type": "read", "slots": {"file": "f"}}]
    asked = requests(spark, [
        ("no guard", "o", "pay", None, [], [], None, {"vip": "no"}), ("guard", "o", "pay", None, ["check"], [], None, {"vip": "no"}), ("no fact", "o", "pay", None, [], [], None, {}),
        ("no contact", "o", "pay", None, [], None, None, {"vip": "no"}), ("hint", "o", None, None, [], [], None, {"vip": "yes"}), ("nothing", "p", "pay", None, [], [], None, {}),
        ("same", "o", "edit", {"file": "f"}, [], [], slots, {"vip": "no"}), ("other", "o", "edit", {"file": "g"}, [], [], slots, {"vip": "no"}), ("no slot", "o", "edit", {}, [], [], slots, {"vip": "no"}),
    ])
    vip = [("vip", "eq", ["no"])]
    duties = spark.createDataFrame([("o", "r1", patterns.WITHOUT, "pay", ["check"], None, vip), ("o", "r2", patterns.SAME, "edit", ["read"], "file", [])], OBLIGATION)
    hints = spark.createDataFrame([("o", "h", "call", [("vip", "eq", ["yes"])])], HINT)
    got = {r["request"]: (r["verdict"], r["missing"]) for r in advise.advise(asked, duties, hints).collect()}
    assert got == {
        "no guard": ("warn", []), "guard": ("clear", []), "no fact": ("abstain", ["vip"]), "no contact": ("abstain", ["contact"]), "hint": ("recommend", []), "nothing": ("abstain", []),
        "same": ("clear", []), "other": ("warn", []), "no slot": ("abstain", ["considering.slot.file"]),
    }


def test_observations_only_ever_add(spark):
    """An observed fact more never withdraws a warning, adds to what is missing or lowers the verdict."""
    r, order = random.Random(1), {"abstain": 0, "clear": 1, "recommend": 2, "warn": 3}
    names = ["obs.a", "obs.b", "vip"]
    duties = spark.createDataFrame([("o", f"r{k}", r.choice([patterns.IMPLIES, patterns.WITHOUT, patterns.ONCE]), "pay", ["check"], None, [(n, "eq", ["true"]) for n in r.sample(names, r.randint(0, 2))]) for k in range(12)], OBLIGATION)
    hints = spark.createDataFrame([("o", f"h{k}", "call", [(n, "eq", ["true"]) for n in r.sample(names, r.randint(1, 2))]) for k in range(4)], HINT)
    less, more = [], []
    for k in range(200):
        known = {n: r.choice(["true", "false"]) for n in names if r.random() < 0.5}
        base = (f"q{k}", "o", "pay", None, r.choice([[], ["check"], ["pay"]]), r.choice([None, [], ["check"]]), None)
        less.append((*base, {n: v for n, v in known.items() if not n.startswith("obs.")}))
        more.append((*base, known))
    a, b = ({x["request"]: x for x in advise.advise(requests(spark, rows), duties, hints).collect()} for rows in (less, more))
    for q in a:
        assert set(a[q]["warned"]) <= set(b[q]["warned"]) and set(b[q]["missing"]) <= set(a[q]["missing"]) and order[a[q]["verdict"]] <= order[b[q]["verdict"]]


def test_same_slot_without_contact(spark):
    """The reference's three values: found in the episode, unknown without a contact, unknown by a guard without the slot, warned of."""
    duty = spark.createDataFrame([("o", "r", patterns.SAME, "pay", ["check"], "order", [])], OBLIGATION)
    hints = spark.createDataFrame([], HINT)
    event = lambda *slots: [("check", dict(slots))]
    cases = [([], None, None), (["check"], None, event(("order", "7"))), ([], [], []), ([], ["check"], event(("order", "8"))), ([], ["check"], event()), ([], ["check"], None), (["check"], [], None)]
    rows = [(f"q{k}", "o", "pay", {"order": "7"}, before, contact, slots, {}) for k, (before, contact, slots) in enumerate(cases)]
    got = {x["request"]: (x["verdict"], x["missing"]) for x in advise.advise(requests(spark, rows), duty, hints).collect()}
    assert [got[f"q{k}"][0] for k in range(7)] == ["abstain", "clear", "warn", "warn", "abstain", "abstain", "abstain"]
    assert got["q0"][1] == ["contact"] and got["q4"][1] == got["q5"][1] == ["slot.order"]


def test_alignment_kinds(spark):
    from rulewright.operators.evaluate import CLAUSES, align, gate

    clause = lambda i, shape, subject, guard, fact=None, value=None: (i, i, True, None, shape, subject, guard, "interaction", False, fact, value)
    clauses = [clause("p1", "precedence", "x", "y", "flow", "a"), clause("p2", "precedence", "x", "y", "flow", "b"), clause("p3", "precedence", "x", "z", "flow", "a"), clause("p4", "precedence", "x", "z"), clause("o1", "at-most-one", "x", None, "flow", "a")]
    rules = [("w", patterns.WITHOUT, ["y"], None, None), ("z", patterns.IMPLIES, ["z"], None, None), ("e", patterns.EXACTLY, ["y"], None, None), ("c", patterns.WITHOUT, ["y"], "flow", "b"),
             ("d", patterns.WITHOUT, ["y"], "other", "b"), ("o", patterns.ONCE, [], "flow", "b"), ("q", patterns.ONCE, [], "flow", "a"), ("n", patterns.ONCE, [], None, None), ("s", patterns.SAME, ["y", "z"], "flow", "b")]
    table = spark.createDataFrame([(i, "s", p, "x", g, f, v) for i, p, g, f, v in rules], "id string, scope string, pattern string, subject string, guards array<string>, fact string, value string")
    got = sorted((x["rule"], x["clause"], x["kind"]) for x in align(table, spark.createDataFrame(clauses, CLAUSES)).collect())
    want = [("w", "p1", "exact"), ("w", "p2", "exact"), ("z", "p3", "general"), ("z", "p4", "exact"), ("c", "p2", "exact"), ("d", "p1", "proposed"), ("d", "p2", "proposed"), ("o", "o1", "proposed"), ("q", "o1", "exact"), ("n", "o1", "general")]
    assert got == sorted(want + [("s", c, "proposed") for c in ("p1", "p2", "p3", "p4")])
    measured = spark.createDataFrame([(0.9, None, None), (None, 0.9, 0.9), (0.9, 0.6, 0.9)], "precision_lenient double, recall_lenient double, refusal_correct double")
    assert [x["gate"] for x in gate(measured).collect()] == ["between", "unmeasured", "target"]


def test_recommendations_stop_at_what_explains(spark):
    facts = lambda k: {"a": "1" if k < 20 else "2", "b": "1" if k % 20 < 18 else "2", "c": "1" if k % 20 < 16 else "2"}
    rows = [(f"p{k}", "o", "send" if k < 19 else "hold", facts(k), None) for k in range(40)]
    points = spark.createDataFrame(rows, "point string, operator string, action string, facts map<string,string>, good boolean")
    may = spark.createDataFrame([("send", True), ("hold", True)], "action string, may boolean")
    rules, _ = recommend.recommend(points, may)
    assert sorted(x["conditions"] for x in rules.collect()) == [["a = 1"], ["a = 2"]]


def test_half_matches(spark):
    row = spark.createDataFrame([("over there", r"\bthe\b"), ("the end", r"\bthe\b"), ("none", r"\bthe\b"), ("x", r"\d+")], "text string, pattern string")
    assert [x[0] for x in row.select(observe.pattern_observer(F.col("text"), F.col("pattern"))).collect()] == [0.6, 0.97, 0.05, 0.05]


def test_recommendations(spark):
    rows = [(f"p{k}", "o", "send" if k < 10 else "hold", {"color": "red" if k < 10 else "blue", "size": "big" if k % 2 else "small"}, True if k < 8 else None) for k in range(20)]
    points = spark.createDataFrame(rows, "point string, operator string, action string, facts map<string,string>, good boolean")
    may = spark.createDataFrame([("send", True), ("hold", False)], "action string, may boolean")
    rules, withheld = recommend.recommend(points, may)
    assert [(r["conditions"], r["action"], r["matched"], r["selected"], r["good"], r["judged"]) for r in rules.collect()] == [(["color = red"], "send", 10, 10, 8, 8)]
    assert [tuple(r) for r in withheld.collect()] == [("o", "hold", 1)]
    assert recommend.covered(rules, points).count() == 1


def test_vocabulary_of_observed_facts(spark):
    from rulewright.operators.facts import vocabulary

    rows = [("o", "s", {"obs.x": "true"} if k < 6 else {}) for k in range(10)] + [("o", "t", {"slot.a": "1"}) for _ in range(10)]
    found = vocabulary(spark.createDataFrame(rows, "operator string, subject string, facts map<string,string>"), Thresholds())
    assert [tuple(r) for r in found.collect()] == [("o", "s", "obs.x", "true", 6)]


def test_bands_and_drift(spark):
    rows = [("p", 0.95 if k % 2 else 0.05, bool(k % 2)) for k in range(80)] + [("q", 0.5, bool(k % 2)) for k in range(80)]
    got = {r["pred"]: r for r in observe.derive_bands(spark.createDataFrame(rows, "pred string, p double, label boolean")).collect()}
    assert got["p"]["problem"] is None and got["p"]["assert_at"] > 0.05 and got["q"]["problem"] == "labels not separated"
    line = "interaction string, episode string, seq int, pred string, p double, value string"
    a, b = spark.createDataFrame([("i", "e", 0, "p", 0.9, "true"), ("i", "e", 1, "p", 0.5, None)], line), spark.createDataFrame([("i", "e", 0, "p", 0.95, None), ("i", "e", 2, "p", 0.5, None)], line)
    assert tuple(observe.drift(a, b).first()) == ("p", 1, 1, 1, 1, 1)
    assert observe.digest(a) == observe.digest(a.repartition(3)) != observe.digest(b)


def test_typing(spark):
    rows = spark.createDataFrame([("refund", "eu"), ("refund", ""), ("other", "us")], "button string, region string")
    got = rows.select(classify({"button": F.col("button"), "region": F.col("region")}, [("action:refund:${region}", {"button": "refund"})]).alias("t"))
    assert [r["t"] for r in got.collect()] == ["action:refund:eu", "unknown", "unknown"]
    with pytest.raises(ValueError):
        scope_by(rows, "nowhere")
    with pytest.raises(ValueError):
        alphabet(spark, [{"type": "x", "consequence": "irreversible"}])


def test_sources(spark, tmp_path):
    log = {"corpus": "c", "interactions": [{"id": "i1", "operator": "o", "team": "t", "agent": "a", "startedAt": 1000, "outcome": "resolved", "turns": [{"speaker": "customer", "intent": "refund request"}, {"speaker": "action", "button": "issue-refund", "slots": {"id": "7"}}]}]}
    (tmp_path / "d.json").write_text(json.dumps(log, indent=1))
    found, contacts = logs.dialogues(spark, str(tmp_path / "d.json"))
    assert [(r["seq"], r["kind"], r["type"], r["at"]) for r in found.orderBy("seq").collect()] == [(0, "customer_intent", "intent:refund_request", 1000), (1, "action", "action:issue_refund", 1001)]
    assert contacts.first()["outcome"] == "resolved"
    lines = [{"session": "s", "timestamp": "2024-01-01T00:00:01Z", "type": "user", "text": "go"}, {"session": "s", "timestamp": "2024-01-01T00:00:02Z", "type": "assistant", "tool": "shell", "command": "cd x && git add . | tee l; FOO=1 make\ncat <<EOF\nrm -rf y && z\nEOF"}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert [r["type"] for r in logs.transcripts(spark, str(tmp_path / "t.jsonl")).orderBy("seq").collect()] == ["customer_utterance", "action:cd", "action:git", "action:make", "action:cat"]
    xes = '<log><trace><string key="concept:name" value="t1"/><event><string key="concept:name" value="A Create"/><string key="org:resource" value="u1"/><date key="time:timestamp" value="2024-01-01T00:00:00.000+00:00"/></event><event><string key="concept:name" value="B"/><string key="org:resource" value="u1"/></event></trace></log>'
    (tmp_path / "l.xml").write_text(xes.replace('key=', '_k=').replace("_k=", "key="))
    calls = {"task_id": "1", "trial": "0", "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "tool_calls": [{"name": "find", "arguments": {"id": "1"}}, {"name": "pay", "arguments": {}}]}, {"role": "tool", "content": "ok"}]}
    (tmp_path / "model.jsonl").write_text(json.dumps(calls))
    rows = logs.tool_calls(spark, str(tmp_path / "model.jsonl")).orderBy("seq").collect()
    assert [(r["seq"], r["type"]) for r in rows] == [(0, "customer_utterance"), (1, "action:find"), (2, "action:pay"), (3, "system")] and rows[0]["interaction"] == "model/1/0"
    pointed = spark.createDataFrame([('{"a":[{"b/c":5}]}',)], "json string").select(logs.pointed(None, "/a/0/b~1c").alias("v"))
    assert pointed.first()["v"] == "5"


def test_process_log(spark, tmp_path):
    (tmp_path / "l.xes").write_text('<log><trace><string key="concept:name" value="t1"/><event><string key="concept:name" value="A Create"/><string key="org:resource" value="u1"/><date key="time:timestamp" value="2024-01-01T00:00:00.000+00:00"/></event><event><string key="concept:name" value="B"/><string key="org:resource" value="u1"/><date key="time:timestamp" value="2024-01-01T00:00:01.000+00:00"/></event></trace></log>')
    rows = logs.process_log(spark, str(tmp_path / "l.xes")).orderBy("seq").collect()
    assert [(r["interaction"], r["type"], r["agent"]) for r in rows] == [("t1", "action:a_create", "u1"), ("t1", "action:b", "u1")] and rows[1]["at"] - rows[0]["at"] == 1000


def test_written_files(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("- {id: c1, shape: precedence, subject: a, guard: b}\n- {id: c2, expressible: false, reason: tone}\n")
    assert written.policy(spark, str(tmp_path / "p.yaml")).count() == 2
    (tmp_path / "bad.yaml").write_text("- {id: c1, shape: precedence, subject: a}\n")
    with pytest.raises(ValueError):
        written.policy(spark, str(tmp_path / "bad.yaml"))
    written.write_gold([{"rule": "r", "clause": "c", "verdict": "confirmed", "rater": "x"}], str(tmp_path / "g.yaml"))
    assert written.gold(spark, str(tmp_path / "g.yaml")).first()["verdict"] == "confirmed"


def test_gold_of_people(spark):
    gold = spark.createDataFrame([("r1", "c1", "confirmed", "a"), ("r1", "c1", "rejected", "b"), ("r2", "c2", "rejected", "a"), ("r2", "c2", "rejected", "b"), ("r3", "c3", "confirmed", "a"), ("r4", "c4", "rejected", "a")], "rule string, clause string, verdict string, rater string")
    pairs = spark.createDataFrame([("r1", "s", "c1", "exact"), ("r4", "s", "c4", "proposed")], "rule string, scope string, clause string, kind string")
    assert tuple(evaluate.gold_report(gold, pairs).first()) == (4, 2, 1, 2, 2)  # what is proposed is matched; what isn't, confirmed or not, is missed


def test_empty_corpus(spark, terms):
    nothing = events(spark, {"x": [(0, "action:read", {})]}).limit(0)
    assert instances(nothing, terms).count() == 0 and mine(nothing, terms).count() == 0
    assert one_episode(nothing.drop("episode")).count() == 0


def test_streams(spark, tmp_path):
    from rulewright.streaming import live

    source = tmp_path / "in"
    source.mkdir()
    rows = [("i", "2024-01-01T00:00:00", "a"), ("i", "2024-01-01T00:00:05", "b"), ("i", "2024-01-01T00:00:09", "a")]
    (source / "1.json").write_text("\n".join(json.dumps(dict(zip(("interaction", "at", "type"), r))) for r in rows))
    stream = spark.readStream.schema("interaction string, at timestamp, type string").json(str(source))
    query = live.live_before(stream).writeStream.format("memory").queryName("before").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r["seq"], r["type"], r["before"]) for r in spark.sql("select * from before order by seq").collect()] == [(0, "a", []), (1, "b", ["a"]), (2, "a", ["a", "b"])]
    done = live.live_sessions(stream).writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "c2")).start()
    done.processAllAvailable()
    done.stop()
    answers, out = [], requests(spark, [("q", "o", "pay", None, [], [], None, {})])
    out.write.parquet(str(tmp_path / "req"))
    duties = spark.createDataFrame([("o", "r1", patterns.IMPLIES, "pay", ["check"], None, [])], OBLIGATION)
    asked = spark.readStream.schema(out.schema).parquet(str(tmp_path / "req"))
    q = live.advice(asked, duties, spark.createDataFrame([], HINT), lambda df, n: answers.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.processAllAvailable()
    q.stop()
    assert [a["verdict"] for a in answers] == ["warn"]


def test_library_does_not_import_the_training_data_operators():
    from pathlib import Path

    top = Path(__file__).resolve().parent.parent / "rulewright"
    for p in top.rglob("*.py"):
        if "llm" not in p.relative_to(top).parts:
            assert "llm" not in p.read_text(), p


def test_slots_before(spark):
    from rulewright.operators.facts import slots_before, vocabulary, with_facts

    rows = [("i", "e", 0, {"file": "a"}), ("i", "e", 1, {"file": None, "x": "1"}), ("i", "e", 2, {"file": "b"}), ("i", "e", 2, {}), ("i", "e", 3, {"x": "2"}), ("i", "f", 9, {"file": "z"})]
    logs = spark.createDataFrame(rows, "interaction string, episode string, seq int, slots map<string,string>")
    got = {(r["episode"], r["seq"]): r["slots"] for r in slots_before(logs.dropDuplicates(["episode", "seq"]), logs).collect()}
    assert got == {("e", 1): {"file": "a"}, ("e", 2): {"file": "a", "x": "1"}, ("e", 3): {"file": "b", "x": "1"}}
    points = spark.createDataFrame([("o", "s", {"slot.k": v}) for v in ["h#0a1b2c3d"] * 9 + ["x"] * 9 + ["y"] * 9], "operator string, subject string, facts map<string,string>")
    assert {r["value"] for r in vocabulary(points, Thresholds()).collect()} == {"x", "y"}
    known = with_facts(logs.select("interaction", "episode", "seq").dropDuplicates(), slots=slots_before(logs.dropDuplicates(["episode", "seq"]), logs))
    assert {r["seq"]: r["facts"] for r in known.where("episode = 'e'").collect()}[2] == {"slot.file": "a", "slot.x": "1"}


def test_provenance_of_recommendations(spark):
    rows = [(f"{o}{k}", o, f"{o}-t{k % 2}", None, "send" if k < n else "hold", {"a": "1", "b": str(k % 2)}) for o, n in (("o1", 10), ("o2", 9), ("o3", 8), ("o4", 2)) for k in range(10)]
    rows += [(f"o5{k}", "o5", "o5-t", None, "send" if k % 2 else "hold", {"a": "1", "b": str(k % 2)}) for k in range(10)]
    points = spark.createDataFrame(rows, "point string, operator string, team string, agent string, action string, facts map<string,string>")
    rules = spark.createDataFrame([(o, ["a = 1"], "send") for o in ("o1", "o4")] + [("o5", ["a = 1", "b = 1"], "send"), ("o5", ["a = 1", "b = 0"], "send"), ("o4", ["a = 9"], "send")], "operator string, conditions array<string>, action string")
    got = {(r["operator"], " and ".join(r["conditions"])): r for r in recommend.with_provenance(rules, points, Thresholds(borrowed_operators=3)).collect()}
    own, lent = got["o1", "a = 1"], got["o4", "a = 1"]
    assert (own["verdict"], own["level"], own["holds"], own["of"]) == ("own", "operator", 10, 10)
    assert (lent["verdict"], lent["found_in"], lent["holds"], lent["of"]) == ("borrowed", ["o1", "o2", "o3"], 2, 10)
    assert got["o5", "a = 1 and b = 1"]["verdict"] == "own" and got["o5", "a = 1 and b = 0"]["verdict"] == "borrowed"
    assert ("o4", "a = 9") not in got  # nothing was decided there
    listed = recommend.as_rules(recommend.with_provenance(rules, points).withColumns({c: F.lit(0) for c in ("matched", "selected", "good", "judged")}), points)
    assert {r["status"] for r in listed.collect()} == {"proposed"}


def test_tribal_rules_and_their_flows(spark):
    from rulewright.operators import diff

    clauses = spark.createDataFrame([("c1", "", True, None, "precedence", "pay", "check", "interaction", False, "episode.intent", "a"), ("c2", "", False, "tone", None, None, None, "interaction", False, None, None)], evaluate.CLAUSES)
    flow = lambda v: [("episode.intent", "eq", [v]), ("vip", "eq", ["true"])]
    rows = [("one", patterns.EXACTLY, ["check"], flow("a")), ("two", patterns.EXACTLY, ["check"], flow("b")), ("three", patterns.IMPLIES, ["check"], flow("a")), ("four", patterns.IMPLIES, ["look"], []), ("five", patterns.EXACTLY, ["check"], [])]
    rules = spark.createDataFrame([(i, "s", p, "pay", g, c, i) for i, p, g, c in rows], f"id string, scope string, pattern string, subject string, guards array<string>, conditions array<{CONDITION}>, text string")
    exercised = spark.createDataFrame([("c1", 1, 0, 1)], "clause string, exercised long, violated long, kept long")
    got = {r["id"]: (r["kind"], r["elsewhere"]) for r in diff.regions(rules, evaluate.align(rules, clauses), clauses, exercised).collect()}
    assert got == {"one": ("novel", None), "two": ("extended-beyond-policy", ["a"]), "three": ("confirmed", None), "four": ("novel", None), "five": ("extended-beyond-policy", ["a"]), "c2": ("tone", None)}
    pairs = spark.createDataFrame([("s", "two", "one", "cycle"), ("s", "one", "two", "cycle"), ("s", "one", "gone", "cycle")], "scope string, rule_a string, rule_b string, reason string")
    assert [(r["a"], r["b"], r["b_text"]) for r in diff.disputed(pairs, rules).collect()] == [("one", "two", "two")]
    assert [tuple(r) for r in evaluate.inexpressible(clauses).collect()] == [("tone", 1)]


def test_edges_keep_off_modes(spark):
    rows = [("p", 0.9, True)] * 30 + [("p", 0.93, True)] * 10 + [("p", 0.91 + k / 100, True) for k in range(5)] + [("p", 0.1, False)] * 40 + [("p", None, None)]
    labelled = spark.createDataFrame(rows, "pred string, p double, label boolean")
    got = observe.derive_bands(labelled, Thresholds(min_predicate_precision=0.99)).first()
    assert (got["assert_at"], got["refute_at"]) == (0.13, None)  # 0.11 is too near to 0.1; what would refute lies above
    assert {(r["label"], r["p"]): r["n"] for r in observe.observed_distribution(labelled).collect()}["unsure", None] == 1


def rows_made(plan):
    """Output rows of each join of an executed plan."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return rows_made(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return rows_made(plan.plan())
    own = [plan.metrics().get("numOutputRows").get().value()] if "Join" in kind else []
    below = plan.children()
    return own + [n for k in range(below.size()) for n in rows_made(below.apply(k))]


def test_conditions_against_all_values(spark):
    """Conditions that explain failing rules are those of trying each value at each instance; instances don't meet the values of others."""
    from collections import defaultdict

    from rulewright.operators import facts
    from rulewright.operators.patterns import EXACTLY, IMPLIES

    r = random.Random(3)
    checked = []
    for n in range(1200):
        kept, one, flow = r.random() < 0.5, n % 3 == 0, r.choice("abc")
        for seq in range(3):
            value, intent = r.randrange(60), r.choice([None, flow, "d"])
            holds = kept if one else r.random() < (0.9 if value < 20 else 0.2)
            known = {"slot.x": str(value)} | ({"obs.y": intent} if intent else {})
            checked.append(("one" if one else "two", EXACTLY if one else IMPLIES, "op", f"c{n % 50}", f"e{n}", seq, "x", holds, known))
    columns = "spec string, pattern string, operator string, interaction string, episode string, seq int, subject string, holds boolean, facts map<string,string>"
    table = spark.createDataFrame(checked, columns)
    values = sorted({(f, v) for row in checked for f, v in row[8].items()})
    words = spark.createDataFrame([("op", "x", f, v) for f, v in values], "operator string, subject string, fact string, value string")
    failing = spark.createDataFrame([("one", "op", EXACTLY), ("two", "op", IMPLIES)], "spec string, operator string, pattern string")
    t = Thresholds(min_instances=3, implies_support=0.55, max_guard_rules=1000)
    got = facts.discriminating(table, failing, words, t)
    rows = got.collect()
    want = set()
    for spec in ("one", "two"):
        for fact, value in values:
            sides = {True: defaultdict(list), False: defaultdict(list)}
            for s, _, _, _, episode, seq, _, holds, known in checked:
                if s == spec and fact in known:
                    sides[known[fact] == value][episode, seq if spec == "two" else -1].append(holds)
            (yes, no), share = (sides[True], sides[False]), lambda units: sum(map(all, units.values())) / len(units)
            n, other = sum(map(len, yes.values())), sum(map(len, no.values()))
            if len(yes) >= 3 and n >= 3 and other >= 3 and share(yes) >= 0.55 > share(no):
                want.add((spec, fact, value, n, other))
    assert want and {(x["spec"], x["fact"], x["value"], x["selected"], x["complement"]) for x in rows} == want
    assert max(rows_made(got._jdf.queryExecution().executedPlan())) <= 2 * len(checked)
