"""The tables of the engine, and the thresholds of mining.

events        a row for each event of a contact: interaction, episode, seq (from 0 in the contact), at, kind, type,
              slots map<string,string>, text, operator, team, agent
interactions  a row for each contact: interaction, operator, team, agent, outcome, facts map<string,string>
alphabet      type, consequence, identity array<string>, recommendable, label
rules         see plans/mine.py
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

EVENT_KINDS = ("customer_intent", "customer_utterance", "agent_utterance", "action", "system", "unknown")
#: From nothing to what can't be undone.
CONSEQUENCES = ("none", "reversible", "compensable", "irreversible")
UNKNOWN_TYPE = "unknown"
GOOD_OUTCOMES = ("resolved", "accepted")
ALPHABET = "type string, consequence string, identity array<string>, recommendable boolean, label string"
#: Order of statuses in a report.
STATUSES = ("proposed", "real", "narrowed", "contradicted", "suppressed", "refused", "not_real", "retired")


@dataclass(frozen=True)
class Thresholds:
    """What counts as evidence; every report names its own."""

    min_instances: int = 5
    implies_support: float = 0.9
    own_support: float = 0.6
    guard_support: float = 0.5
    max_guard_rules: int = 3
    max_counterexamples: int = 20
    borrowed_operators: int = 3
    recommend_agreement: float = 0.8
    recommend_gain: float = 0.05
    recommend_novelty: float = 0.5
    antecedent_max_length: int = 3
    antecedent_floor_exponent: float = 1.0
    reproposal_delta: float = 0.1
    min_calibration: int = 60
    min_label: int = 15
    min_predicate_precision: float = 0.9
    min_label_separation: float = 0.2
    max_condition_values: int = 64
    unknown_rate: float = 0.2


def alphabet(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """entries: type, consequence, and optionally identity, recommendable, label.

    An irreversible type must say whether it may be recommended; others may by default.
    """
    rows = []
    for e in entries:
        if e["consequence"] not in CONSEQUENCES:
            raise ValueError(f"{e['type']}: consequence {e['consequence']}")
        if e["consequence"] == "irreversible" and "recommendable" not in e:
            raise ValueError(f"{e['type']}: an irreversible type must say whether it is recommendable")
        rows.append((e["type"], e["consequence"], list(e.get("identity", [])), bool(e.get("recommendable", True)), e.get("label")))
    return spark.createDataFrame(rows, ALPHABET)
