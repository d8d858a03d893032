"""Live observation: repeated texts, later answers, a budget, an observer that fails, late requests."""

import datetime as dt

import pytest

from rulewright.functions.logic import CONDITION
from rulewright.operators.advise import REQUESTS
from rulewright.streaming.observed import EVENTS, observed_advice

PREDICATES = "pred string, fact string, window string, pattern string, assert_at double, refute_at double"
OBLIGATION = f"operator string, id string, pattern string, subject string, guards array<string>, slot string, conditions array<{CONDITION}>"
HINT = f"operator string, id string, action string, conditions array<{CONDITION}>"
CALLS = "/calls"


def event(text, kind="say", **slots):
    return (kind, text, slots or None)


def request(name, minute, *events, facts=None):
    return (name, "o", "pay", None, [], [], None, facts or {}, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), list(events))


def counting(path, fails=None):
    def observe(text, patterns):
        with open(path, "a") as f:
            f.write(text + "\n")
        if fails and fails in text:
            raise OSError("no answer")
        return [0.97 if p in text else 0.5 if "maybe" in text else 0.05 for p in patterns]

    return observe


@pytest.fixture
def run(spark, tmp_path):
    schema = f"{REQUESTS}, at timestamp, events {EVENTS}"
    predicates = spark.createDataFrame([("p1", "obs.angry", "event.text", "angry", 0.9, 0.1), ("p2", "obs.order", "slot.order", "x", 0.9, 0.1)], PREDICATES)
    angry = [("obs.angry", "eq", ["true"])]
    duties = spark.createDataFrame([("o", "calm first", "X-implies-prior-Y", "pay", ["check"], None, angry)], OBLIGATION)

    def batches(*rows, **bounds):
        calls, said = str(tmp_path / "calls"), []
        open(calls, "w").close()
        fails = bounds.pop("fails", None)
        for k, batch in enumerate(rows):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            q = observed_advice(stream, predicates, duties, spark.createDataFrame([], HINT), lambda df, n: said.extend(df.collect()), counting(calls, fails), 3, shards=2, **bounds)
            q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return {r["request"]: r for r in said}, open(calls).read().splitlines()

    return batches


def test_repeats_and_later_answers(run):
    said, calls = run(
        [request("a", 0, event("very angry")), request("b", 1, event("very angry"), event("fine now")), request("c", 2, event("fine now"), event("maybe"))],
        [request("d", 3, event("very angry")), request("e", 4), request("f", 5, event(" ")), request("g", 6, event("angry", facts="x"), facts={"obs.angry": "false"}), request("h", 7, event(None, order="no x"))],
    )
    assert sorted(calls) == sorted(["very angry", "fine now", "maybe", "angry", "no x"])  # each text once, over both runs
    assert {k: r["verdict"] for k, r in said.items()} == {"a": "warn", "b": "abstain", "c": "abstain", "d": "warn", "e": "abstain", "f": "abstain", "g": "abstain", "h": "abstain"}
    assert [tuple(o) for o in said["a"]["observations"]] == [("obs.angry", 0.97, "true", 3)] and said["a"]["fired"] == ["calm first"] and said["a"]["observer"] == "live"
    assert said["b"]["observations"][0]["value"] == "false" and said["c"]["observations"][0]["value"] == "false"  # a withheld one takes nothing back
    assert said["e"]["observer"] == said["f"]["observer"] == "null (no text in the request)" and said["e"]["missing"] == ["obs.angry"]
    assert said["g"]["reason"] == "uncovered"  # what the request says itself wins
    assert said["h"]["observations"][0]["fact"] == "obs.order"


def test_errors_take_all_observations_of_a_request(run):
    said, calls = run([request("a", 0, event("very angry"), event("broken")), request("b", 1, event("broken")), request("c", 2, event("very angry"))], fails="broken")
    assert calls.count("broken") == 2 and said["a"]["observer"] == said["b"]["observer"] == "null (unreachable: no answer)"
    assert said["a"]["observations"] == [] and said["a"]["verdict"] == "abstain" and said["c"]["verdict"] == "warn"


def test_budget(run):
    texts = [f"angry {k}" for k in range(12)]
    said, calls = run([request(f"r{k:02}", k, event(t)) for k, t in enumerate(texts)], [request("again", 20, event(calls_first := texts[0])), request("x", 21, event("angry else"))], budget=4)
    assert len(calls) == 4 and sum(r["observer"] == "live" for k, r in said.items() if k != "again") == 4
    assert said["x"]["observer"] == "null (budget spent)" and said["again"]["observer"] == ("live" if calls_first in calls else "null (budget spent)")


def test_late_requests_and_forgetting(run):
    said, calls = run(
        [request("a", 0, event("very angry"))], [request("b", 60 * 24 * 3, event("other"))], [request("c", 60 * 24 * 3 + 1, event("very angry")), request("late", 1, event("late one"))],
        late="1 minute", forget="1 day",
    )
    assert calls == ["very angry", "other", "very angry"] and "late" not in said and said["c"]["verdict"] == "warn"
