"""Instances of subjects and what came before them.

"Some Y earlier" is answered by first occurrences: the least seq of each type in each episode or contact is less than
the instance's. That is an aggregate and an equi-join, so that a contact of any length is no window partition,
and it counts types of a contact, not pairs of its events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .typing import consequential, is_action

KEY = ["interaction", "episode", "seq"]
ACTOR = ["operator", "team", "agent"]


def instances(events: DataFrame, alphabet: DataFrame, floor: str = "compensable") -> DataFrame:
    """KEY, at, ACTOR, subject, slots, identity, recommendable: every consequential event."""
    found = consequential(events, alphabet, floor)
    return found.select(*KEY, "at", *ACTOR, F.col("type").alias("subject"), "slots", "identity", "recommendable")


def firsts(events: DataFrame, scope: str) -> DataFrame:
    """scope (`episode` or `interaction`), guard, first, times: of each type of action there."""
    return events.where(is_action()).groupBy(scope, F.col("type").alias("guard")).agg(F.min("seq").alias("first"), F.count("*").alias("times"))


def as_maps(firsts_: DataFrame, scope: str) -> DataFrame:
    """scope, firsts: firsts_ (as firsts() gives them) as one map of guard to (first, times). It has an entry a type there, not one an event."""
    return firsts_.groupBy(scope).agg(F.map_from_entries(F.collect_list(F.struct("guard", F.struct("first", "times")))).alias("firsts"))


def with_firsts(found: DataFrame, firsts_in_episode: DataFrame, firsts_in_contact: DataFrame) -> DataFrame:
    """found with in_episode and in_contact, the maps of its episode and contact (null if that has no action)."""
    found = found.join(as_maps(firsts_in_episode, "episode").withColumnRenamed("firsts", "in_episode"), "episode", "left")
    return found.join(as_maps(firsts_in_contact, "interaction").withColumnRenamed("firsts", "in_contact"), "interaction", "left")


def earlier(found: DataFrame, events: DataFrame, scope: str) -> DataFrame:
    """found with guard: a row for each instance and type of action, not its own, that came earlier in the scope."""
    return found.join(firsts(events, scope), scope).where("first < seq and guard <> subject").drop("first", "times")


def slot_values(found: DataFrame) -> DataFrame:
    """found with slot and value: a row for each identity slot of the subject; value null if the instance has none."""
    return found.withColumn("slot", F.explode("identity")).withColumn("value", F.col("slots")[F.col("slot")])


def slot_firsts(events: DataFrame, alphabet: DataFrame) -> DataFrame:
    """interaction, slot, value, guard, first: of each type that has the slot for identity, by the slot's value."""
    terms = F.broadcast(alphabet.select("type", F.explode("identity").alias("slot")))
    typed = events.where(is_action()).join(terms, "type").withColumn("value", F.col("slots")[F.col("slot")])
    return typed.where("value is not null").groupBy("interaction", "slot", "value", F.col("type").alias("guard")).agg(F.min("seq").alias("first"))


def decision_points(found: DataFrame) -> DataFrame:
    """The first consequential action of each episode."""
    least = found.groupBy("episode").agg(F.min("seq").alias("seq"))
    return found.join(least, ["episode", "seq"])


def as_of(sites: DataFrame, observed: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """sites with the value last observed strictly earlier in their partition, by `order`.

    A null (withheld) observation takes nothing back. observed: partition, order, fact, value.
    """
    facts = observed.select("fact").distinct()
    asked = sites.crossJoin(F.broadcast(facts))  # as many as predicates
    both = asked.withColumns({"value": F.lit(None).cast("string"), "site": F.lit(True)}).unionByName(observed.withColumn("site", F.lit(False)), allowMissingColumns=True)
    before = Window.partitionBy(*partition, "fact").orderBy(*order).rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("value", F.last("value", ignorenulls=True).over(before)).where("site").drop("site")
