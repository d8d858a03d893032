"""Sinks, reports and what is made of rules afterwards."""

import json

import pytest

from rulewright.operators import evaluate, recommend
from rulewright.plans import reports
from rulewright.schema import Thresholds
from rulewright.sources import sinks


def test_sinks(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert sinks.open_store(spark, folder) == sinks.open_store(spark, folder) == sinks.SCHEMA_VERSION
    spark.createDataFrame([(99,)], "version int").write.mode("append").parquet(f"{folder}/schema_version")
    with pytest.raises(ValueError):
        sinks.open_store(spark, folder)
    sinks.record_run(spark, folder, {"run": "r1", "command": "mine"}, Thresholds())
    assert json.loads(spark.read.parquet(f"{folder}/runs").first()["thresholds"])["min_instances"] == 5
    answers = spark.createDataFrame([("q1", "warn"), ("q2", "clear")], "request string, verdict string")
    sinks.log_answers(answers, folder, "live")
    for _ in range(2):
        sinks.replace_answers(answers.limit(1), folder, "replay")
    assert sorted((r["source"], r["count"]) for r in spark.read.parquet(f"{folder}/decisions").groupBy("source").count().collect()) == [("live", 2), ("replay", 1)]
    for _ in range(2):
        sinks.insert_once(answers, f"{folder}/once", ["request"])
    assert spark.read.parquet(f"{folder}/once").count() == 2
    lines = spark.createDataFrame([("i", "e", k, "p", 0.5) for k in (2, 0, 1)], "interaction string, episode string, seq int, pred string, p double")
    assert sinks.write_annotations(lines, f"{folder}/notes", partial=True).endswith(".partial")


def test_recommendations_as_rules(spark):
    rules = spark.createDataFrame([("o", "1", [1], ["obs.states_double_charge = true"], "action:escalate", 9, 10, 3, 4)], "operator string, node string, items array<int>, conditions array<string>, action string, matched long, selected long, good long, judged long")
    row = recommend.as_rules(rules, None).first()
    assert row["id"] == "2f663a4cec907cc9" and row["status"] == "proposed" and row["text"] == "When obs.states_double_charge = true, escalate."
    assert "escalate" in reports.table_text(recommend.as_rules(rules, None)) and json.loads(reports.as_json(rules))[0]["matched"] == 9


def test_gold_sample(spark):
    rules = spark.createDataFrame([("r1", "a"), ("r2", "a"), ("r3", "z")], "id string, subject string")
    clauses = spark.createDataFrame([("c1", "a", True), ("c2", "a", True)], "id string, subject string, expressible boolean")
    pairs = spark.createDataFrame([("r1", "s", "c1", "exact")], "rule string, scope string, clause string, kind string")
    sample = evaluate.gold_sample(rules, pairs, clauses)
    assert sorted((r["stratum"], r["rule"], r["clause"]) for r in sample.collect()) == [("exact", "r1", "c1"), ("near-miss", "r1", "c2"), ("near-miss", "r2", "c1"), ("near-miss", "r2", "c2"), ("tribal", "r3", None)]
    gold = spark.createDataFrame([("r1", "c1", "confirmed", "x"), ("r1", "c1", "confirmed", "y")], "rule string, clause string, verdict string, rater string")
    assert tuple(evaluate.gold_progress(sample, gold).where("stratum = 'exact'").first()) == ("exact", 1, 1, 2, 1)
    told = spark.createDataFrame([("c1", 5, 1, 4), ("c2", 5, 0, 5)], "clause string, exercised int, violated int, kept int")
    assert sorted(map(tuple, evaluate.recall_over(pairs, told).collect())) == [("kept", 1, 0, 0), ("violated", 1, 1, 1)]
