"""The rule store: what belongs together is written together, and read as it was."""

import pytest
from pyspark.sql import functions as F

from rulewright.functions.logic import CONDITION
from rulewright.sources import rulestore
from rulewright.sources.rulestore import Conflict, Store, open_rules, persist_mined, record_everywhere, record_verdicts

RULES = f"id string, scope string, status string, verdict string, holds long, of long, conditions array<{CONDITION}>, text string, parent_id string"
SAID = "id string, corpus string, scope string, verdict string, note string, fact string, value string, reviewer string, at timestamp"


@pytest.fixture
def store(spark, tmp_path):
    return open_rules(spark, f"file://{tmp_path}/store")


def rules(spark, rows):
    return spark.createDataFrame([(i, s, status, v, h, o, [], f"{i} of {h}", None) for i, s, status, v, h, o in rows], RULES)


def proof(spark, rows):
    return spark.createDataFrame(rows, "id string, scope string, interaction string, episode string, seq int, holds boolean")


def said(spark, *rows):
    return spark.createDataFrame([(i, c, s, v, n, f, x, "ann", None) for i, c, s, v, n, f, x in rows], SAID)


def statuses(store):
    return {(r["id"], r["scope"]): r["status"] for r in store.table("rules").collect()}


def first_run(spark, store):
    mined = rules(spark, [("a", "o1", "proposed", "own", 9, 10), ("a", "o2", "proposed", "borrowed", 4, 10), ("b", "o1", "proposed", "own", 9, 10), ("c", "o1", "refused", "neither", 1, 10)])
    return persist_mined(store, "x", "r1", mined, proof(spark, [("a", "o1", "i", "e", 1, True), ("c", "o1", "i", "e", 1, False), ("zz", "o1", "i", "e", 1, False)]), spark.createDataFrame([("o1", "a", "b", "cycle")] * 2, "scope string, rule_a string, rule_b string, reason string"))


def test_runs_and_verdicts(spark, store):
    assert first_run(spark, store) == {"inserted": 4}
    assert store.table("contradictions").count() == 1 and store.table("evidence").count() == 2
    record_verdicts(store, said(spark, ("b", None, None, "real", "fine", None, None), ("a", "x", "o1", "not_real", "{not json", None, None)))
    assert statuses(store) == {("a", "o1"): "not_real", ("a", "o2"): "proposed", ("b", "o1"): "real", ("c", "o1"): "refused"}
    second = rules(spark, [("a", "o1", "proposed", "own", 5, 10), ("b", "o1", "proposed", "own", 8, 10), ("d", "o1", "proposed", "own", 8, 10)])
    assert persist_mined(store, "x", "r2", second, proof(spark, [("a", "o1", "i2", "e", 1, True)])) == {"reproposed": 1, "retired": 1, "kept": 1, "removed": 1, "inserted": 1}
    assert statuses(store) == {("a", "o1"): "proposed", ("a", "o2"): "retired", ("b", "o1"): "real", ("d", "o1"): "proposed"}
    rows = {r["id"]: r for r in store.table("rules").where("scope = 'o1'").collect()}
    assert rows["a"]["reproposed_reason"] and rows["a"]["text"] == "a of 5" and rows["b"]["run"] == "r2"
    assert [(r["id"], r["interaction"]) for r in store.table("evidence").collect()] == [("a", "i2")]
    record_verdicts(store, said(spark, ("a", "x", "o1", "real", None, None, None)))
    assert store.table("rules").where("id = 'a' and scope = 'o1'").first()["reproposed_reason"] is None
    assert [r["run"] for r in store.table("runs").orderBy("at").collect()] == ["r1", "r2"]
    seen = rulestore.history(store, "a", "o1").orderBy("at").collect()
    assert [(r["verdict"], r["note"], r["condition"], r["holds"]) for r in seen] == [("not_real", "{not json", None, 9), ("real", None, None, 5)]
    # as of the first run
    assert store.table("rules", store.snapshot(1)).count() == 4 and store.numbers() == [1, 2, 3, 4]


def test_another_corpus_stays(spark, store):
    first_run(spark, store)
    folders = store.snapshot().tables["rules"]["parts"]["x"]
    persist_mined(store, "y", "r9", rules(spark, [("a", "o1", "proposed", "own", 1, 2)]))
    assert store.snapshot().tables["rules"]["parts"]["x"] == folders and store.table("rules").count() == 5
    with pytest.raises(ValueError, match="2 rules"):
        record_verdicts(store, said(spark, ("a", None, "o1", "real", None, None, None)))


def test_all_or_none(spark, store):
    first_run(spark, store)
    before = store.snapshot()
    for bad in (("q", None, None, "real", None, None, None), ("b", None, None, "narrowed", None, None, None), ("b", None, None, "narrowed", None, "obs.x", "true"), ("b", None, None, "perhaps", None, None, None)):
        with pytest.raises(ValueError):
            record_verdicts(store, said(spark, ("c", None, None, "real", None, None, None), bad))
    assert store.snapshot() == before and store.table("adjudications").count() == 0
    record_verdicts(store, said(spark, ("b", None, None, "narrowed", "only then", "obs.x", "true")), ["obs.x"])
    asked = rulestore.requested(store, "x").first()
    assert (asked["parent_id"], asked["conditions"][0]["fact"], asked["conditions"][0]["values"]) == ("b", "obs.x", ["true"])


def test_everywhere(spark, store):
    first_run(spark, store)
    left = record_everywhere(store, "a", "x", "real", "bo")
    assert [(r["scope"], r["borrowed"]) for r in left.collect()] == [("o2", True)]
    assert statuses(store)["a", "o1"] == "real" and statuses(store)["a", "o2"] == "proposed"
    with pytest.raises(ValueError):
        record_everywhere(store, "nothing", "x", "real")


def test_a_lost_writer_leaves_what_was_there(spark, store, monkeypatch):
    first_run(spark, store)
    monkeypatch.setattr(store, "fs", Unwilling(store.fs))
    with pytest.raises(OSError):
        record_verdicts(store, said(spark, ("b", None, None, "real", None, None, None)))
    again = Store(spark, store.folder)
    assert statuses(again)["b", "o1"] == "proposed" and again.table("adjudications").count() == 0
    record_verdicts(again, said(spark, ("b", None, None, "real", None, None, None)))
    assert statuses(again)["b", "o1"] == "real" and again.vacuum() > 0 and statuses(again)["b", "o1"] == "real"


class Unwilling:
    """A file system that writes no more commits."""

    def __init__(self, fs):
        self.fs = fs

    def create(self, *_):
        raise OSError("the machine is gone")

    def __getattr__(self, name):
        return getattr(self.fs, name)


def test_two_writers(spark, store):
    first_run(spark, store)
    base = store.snapshot()
    rows = store.table("rules", base, "x")
    store.commit(base, [("rules", "x", rows.withColumn("status", F.lit("real")), True)])
    with pytest.raises(Conflict):
        store.commit(base, [("rules", "x", rows, True)])
    assert set(statuses(store).values()) == {"real"}


def test_older_versions_open(spark, tmp_path):
    """A store as it was at first, and one whose upgrade was lost after two steps."""
    old = Store(spark, f"file://{tmp_path}/old")
    made = {
        "rules": spark.createDataFrame([("a", "x", "o1", 9, 10, "real"), ("b", "x", "o1", 1, 10, "refused")], "id string, corpus string, scope string, holds long, of long, status string"),
        "adjudications": spark.createDataFrame([("a", "real", "said", 9, 10)], "id string, verdict string, note string, holds long, of long"),
        "evidence": spark.createDataFrame([("a", "i", "e", 1, True)], "id string, interaction string, episode string, seq int, holds boolean"),
        "contradictions": spark.createDataFrame([("r1", "a", "b", "cycle")], "run string, rule_a string, rule_b string, reason string"),
        "decisions": spark.createDataFrame([("q", "o1", "proceed", None)], "request string, operator string, verdict string, why string"),
    }
    old.commit(old.snapshot(), [(n, "x" if n in rulestore.BY_CORPUS else "", rows, True) for n, rows in made.items()], version=1)
    at = old.snapshot()
    for version in (1, 2):
        steps = rulestore.MIGRATIONS[version]({n: old.table(n, at) for n in rulestore.TABLES})
        at = old.commit(at, [(n, "x" if n in rulestore.BY_CORPUS else "", rows, True) for n, rows in steps.items()], version + 1)
    now = open_rules(spark, old.folder)
    assert now.snapshot().version == 7 and len(now.numbers()) == 7
    row = now.table("rules").where("id = 'a'").first()
    assert (row["corpus_holds"], row["corpus_of"], row["parent_id"], row["outcome_of"]) == (9, 10, None, None)
    assert [(r["corpus"], r["scope"]) for n in ("adjudications", "evidence") for r in now.table(n).collect()] == [("x", "o1")] * 2
    assert now.table("contradictions").first()["scope"] == "o1" and now.table("decisions").first()["observer"] is None
    assert persist_mined(now, "x", "r2", rules(spark, [("a", "o1", "proposed", "own", 8, 10)])) == {"kept": 1, "removed": 1}
    record_verdicts(now, said(spark, ("a", None, None, "not_real", None, None, None)))
    assert rulestore.history(now).count() == 2
    now.commit(now.snapshot(), [], version=8)
    with pytest.raises(ValueError, match="version 8"):
        open_rules(spark, old.folder)
