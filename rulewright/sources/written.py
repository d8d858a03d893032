"""What people write: policies, ratings, labels, the list of corpora. Small files, read by the driver."""

from __future__ import annotations

import json
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import CLAUSES

GOLD = "rule string, clause string, verdict string, rater string"
LABELS = "pred string, sha string, text string, label boolean, p double"
ANNOTATIONS = "i string, e string, seq int, pred string, p double, fact string, value string, pv int, redaction string, sha string, at long"


def policy(spark: SparkSession, path: str) -> DataFrame:
    """Clauses of a YAML list; an error for repeated ids, and for an expressible clause without shape or subject."""
    rows, seen = [], set()
    for c in yaml.safe_load(Path(path).read_text()) or []:
        if c["id"] in seen:
            raise ValueError(f"clause {c['id']} is there twice")
        seen.add(c["id"])
        expressible = bool(c.get("expressible", True))
        if expressible and (c.get("shape") not in ("precedence", "at-most-one") or not c.get("subject") or c["shape"] == "precedence" and not c.get("guard")):
            raise ValueError(f"clause {c['id']}: shape, subject or guard is missing")
        when = c.get("when") or {}
        rows.append((c["id"], c.get("text", ""), expressible, c.get("reason"), c.get("shape"), c.get("subject"), c.get("guard"), c.get("window", "interaction"), bool(c.get("adjacent", False)), when.get("fact"), None if "value" not in when else str(when["value"])))
    return spark.createDataFrame(rows, CLAUSES)


def gold(spark: SparkSession, path: str) -> DataFrame:
    rows = yaml.safe_load(Path(path).read_text()) or []
    if bad := [r for r in rows if r.get("verdict") not in ("confirmed", "rejected")]:
        raise ValueError(f"verdict of {bad[0]}")
    return spark.createDataFrame([(r["rule"], r["clause"], r["verdict"], r.get("rater", "")) for r in rows], GOLD)


def write_gold(rows: list[dict], path: str) -> None:
    """Sorted by rule, clause and rater."""
    Path(path).write_text(yaml.safe_dump(sorted(rows, key=lambda r: (r["rule"], r["clause"], r.get("rater", ""))), sort_keys=True))


def labels(spark: SparkSession, path: str) -> DataFrame:
    file = yaml.safe_load(Path(path).read_text())
    return spark.createDataFrame([(file["predicate"], i["sha"], i["text"], i.get("label"), i.get("p")) for i in file["items"]], LABELS)


def write_labels(head: dict, items: list[dict], path: str) -> None:
    """An item's p is left out until it has a label, so that no one rates by it."""
    shown = [{k: v for k, v in i.items() if k != "p" or i.get("label") is not None} for i in items]
    Path(path).write_text(yaml.safe_dump(head | {"items": shown}, sort_keys=False))


def annotations(spark: SparkSession, path: str, pv: int, redaction: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines of this set of predicates and redaction, lines that don't belong here)."""
    lines = spark.read.schema(ANNOTATIONS).json(path)
    fits = F.coalesce((F.col("pv") == pv) & (F.col("redaction") == redaction), F.lit(False))
    own, other = lines.where(fits), lines.where(~fits)
    if known is None:
        return own, other
    foreign = own.join(known.select(F.col("interaction").alias("i")).distinct(), "i", "left_anti")
    return own.join(foreign.select("i").distinct(), "i", "left_anti"), other.unionByName(foreign.select(other.columns))


def config(path: str) -> dict:
    return json.loads(Path(path).read_text())
