"""What a corpus holds before anything is mined from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import UNKNOWN_TYPE, Thresholds
from .typing import consequential


def audit(events: DataFrame, alphabet: DataFrame, t: Thresholds = Thresholds(), floor: str = "compensable") -> DataFrame:
    """One row: interactions, events, episodes, actors, unknown events and shapes, subjects with and without enough instances."""
    subjects = consequential(events, alphabet, floor)
    by_subject = subjects.groupBy("type").count()
    size = by_subject.agg(F.count_if(F.col("count") >= t.min_instances).alias("subjects"), F.count_if(F.col("count") < t.min_instances).alias("below_floor"))
    acting = subjects.agg(F.countDistinct("interaction").alias("acting"))
    unknown = (F.col("type") == UNKNOWN_TYPE) | (F.col("kind") == "unknown")
    whole = events.agg(
        F.countDistinct("interaction").alias("interactions"), F.count("*").alias("events"), F.countDistinct("episode").alias("episodes"),
        F.countDistinct("operator").alias("operators"), F.countDistinct("team").alias("teams"), F.countDistinct("agent").alias("agents"), F.count_if(unknown).alias("unknown_events"),
    )
    row = whole.crossJoin(size).crossJoin(acting)  # one row each
    return row.select(
        "interactions", "events", "episodes", "operators", "teams", "agents", "unknown_events", "subjects", "below_floor",
        F.round(F.col("episodes") / F.col("interactions"), 6).alias("episodes_per_interaction"),
        F.round(1 - F.col("acting") / F.col("interactions"), 6).alias("without_consequence"),
        (F.col("unknown_events") / F.col("events") > t.unknown_rate).cast("int").alias("too_many_unknown"),
        (F.col("subjects") == 0).cast("int").alias("nothing_to_say"),
    )


def subjects(events: DataFrame, alphabet: DataFrame, t: Thresholds = Thresholds(), floor: str = "compensable") -> DataFrame:
    """type, instances, contacts, enough."""
    found = consequential(events, alphabet, floor).groupBy("type").agg(F.count("*").alias("instances"), F.countDistinct("interaction").alias("contacts"))
    return found.withColumn("enough", (F.col("instances") >= t.min_instances).cast("int"))


def outcomes(interactions: DataFrame) -> DataFrame:
    """operator, outcome, interactions; null outcomes are a group."""
    return interactions.groupBy("operator", "outcome").agg(F.count("*").alias("interactions"))


def figure(events: DataFrame, alphabet: DataFrame, which: str, floor: str = "compensable") -> DataFrame:
    """The events behind a figure: `unknown`, `type:X`, `subject:X` or `interaction:X`."""
    kind, _, name = which.partition(":")
    if kind == "unknown":
        return events.where((F.col("type") == UNKNOWN_TYPE) | (F.col("kind") == "unknown"))
    if kind == "type":
        return events.where(F.col("type") == name)
    if kind == "subject":
        return consequential(events, alphabet, floor).where(F.col("type") == name)
    if kind == "interaction":
        return events.where(F.col("interaction") == name)
    raise ValueError(f"no figure {which}")
