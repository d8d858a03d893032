"""What is known at an instance, and which conditions on it are worth trying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logic import CONDITION, rendered
from ..schema import Thresholds
from .instances import KEY
from .patterns import BY_NAME, EXACTLY, IMPLIES, ONCE, SAME, WITHOUT, of_pattern


#: What redaction puts in place of a value: a fixed form.
SURROGATE = r"^[A-Za-z0-9_.]+#[0-9a-f]{6,}$"


def with_facts(found: DataFrame, contact_facts: DataFrame | None = None, intents: DataFrame | None = None, slots: DataFrame | None = None, observed: DataFrame | None = None) -> DataFrame:
    """found with facts: observations, then slots, then the episode's one intent, then the contact's own; later ones win.

    contact_facts: interaction, facts. intents: episode, intent (used if there is one different). slots: KEY and slots map of
    what came earlier in the episode. observed: KEY, fact, value.
    """
    none = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    layers = []
    if observed is not None:
        seen = observed.where("value is not null").groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("fact", "value"))).alias("of_observed"))
        found = found.join(seen, KEY, "left")
        layers.append("of_observed")
    if slots is not None:
        found = found.join(slots.select(*KEY, F.transform_keys("slots", lambda k, v: F.concat(F.lit("slot."), k)).alias("of_slots")), KEY, "left")
        layers.append("of_slots")
    if intents is not None:
        one = intents.groupBy("episode").agg(F.collect_set("intent").alias("all")).where(F.size("all") == 1)
        found = found.join(one.select("episode", F.create_map(F.lit("episode.intent"), F.col("all")[0]).alias("of_intent")), "episode", "left")
        layers.append("of_intent")
    if contact_facts is not None:
        found = found.join(contact_facts.select("interaction", F.col("facts").alias("of_contact")), "interaction", "left")
        layers.append("of_contact")
    merged = none
    for layer in layers:
        merged = overlaid(merged, F.coalesce(F.col(layer), none))
    return found.withColumn("facts", F.map_filter(merged, lambda k, v: v.isNotNull())).drop(*layers)


def slots_before(found: DataFrame, events: DataFrame) -> DataFrame:
    """KEY, slots: for each instance, of each slot the last value that the episode's events strictly before it had; nulls take nothing back.

    A key is a slot of an episode: its values and the instances that ask for it are read once, in order, with one value held. Instances
    without earlier slots have no row.
    """
    said = events.select("episode", "seq", F.explode("slots").alias("slot", "value")).where("value is not null")
    asked = found.select(*KEY).join(said.select("episode", "slot").distinct(), "episode")
    both = asked.select(*KEY, "slot", F.lit(None).cast("string").alias("value"), F.lit(True).alias("site"))
    both = both.unionByName(said.withColumn("site", F.lit(False)), allowMissingColumns=True)
    before = Window.partitionBy("episode", "slot").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    last = both.withColumn("last", F.last("value", ignorenulls=True).over(before)).where("site and last is not null")
    return last.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("slot", "last"))).alias("slots"))


def overlaid(lower: Column, upper: Column) -> Column:
    """Both maps' entries; of keys that both have, upper's."""
    return F.map_concat(F.map_filter(lower, lambda k, v: ~F.map_contains_key(upper, k)), upper)


def vocabulary(rows: DataFrame, t: Thresholds, by: tuple[str, ...] = ("operator", "subject")) -> DataFrame:
    """by, fact, value, n: conditions that select enough rows of a group and not all that could be known.

    What stands for a redacted value is none. A fact of one value is a constant. Only an observed one (obs.*) may have one value, if it is absent somewhere.
    """
    keys = list(by)
    total = rows.groupBy(*keys).agg(F.count("*").alias("rows"))
    counts = rows.select(*keys, F.explode("facts").alias("fact", "value")).where(~F.col("value").rlike(SURROGATE)).groupBy(*keys, "fact", "value").agg(F.count("*").alias("n"))
    kinds = counts.groupBy(*keys, "fact").agg(F.count("*").alias("values"), F.sum("n").alias("present"))
    splits = (F.col("values") >= 2) | (F.col("fact").startswith("obs.") & (F.col("present") < F.col("rows")))
    return counts.join(kinds, [*keys, "fact"]).join(total, keys).where(splits & (F.col("n") >= t.min_instances)).select(*keys, "fact", "value", "n")


def conditioned(specs: DataFrame, vocabulary_: DataFrame) -> DataFrame:
    """operator, spec's columns with each single condition of its operator and subject."""
    one = F.array(F.struct("fact", F.lit("eq").alias("op"), F.array("value").alias("values"))).cast(f"array<{CONDITION}>")
    return specs.drop("conditions").join(vocabulary_, ["operator", "subject"]).withColumn("conditions", one).drop("fact", "value", "n")


def discriminating(checked_all: DataFrame, failing: DataFrame, vocabulary_: DataFrame, t: Thresholds) -> DataFrame:
    """operator, pattern, subject, spec (the plain one), fact, value, selected, kept, complement, rank: conditions that explain a failing rule.

    A condition explains it if the rule reaches its floor where it is true, fails it where the fact is known and
    different, and both sides have enough instances; where the fact is unknown an instance is on neither side.
    The episode's intent goes first and is capped at max_condition_values, else max_guard_rules of the largest.
    checked_all: checks of plain specs, with subject and the instances' facts; failing: spec, operator that fail their floor.
    """
    rows = checked_all.join(F.broadcast(failing), ["spec", "operator", "pattern"])
    keys = ["spec", "pattern", "operator", "subject", "fact"]
    known = rows.select(*keys[:-1], "episode", "holds", F.explode("facts").alias("fact", "value"))
    known = known.where("value is not null").join(F.broadcast(vocabulary_.select("operator", "subject", "fact").distinct()), ["operator", "subject", "fact"], "left_semi")
    once = F.col("pattern").isin(ONCE, EXACTLY)
    fails = (~F.col("holds")).cast("int")
    # a unit's values, and how many of them fail: of an episode, or of an instance, which has one value
    unit = Window.partitionBy(*keys, "episode")
    episodes = known.where(once).groupBy(*keys, "episode", "value").agg(F.bool_and("holds").alias("holds"), F.count("*").alias("n"))
    episodes = episodes.withColumns({"values": F.count("*").over(unit), "failed": F.sum(fails).over(unit), "head": F.col("value") == F.min("value").over(unit)}).drop("episode")
    alone = known.where(~once).drop("episode").withColumns({"n": F.lit(1).cast("long"), "values": F.lit(1).cast("long"), "failed": fails.cast("long"), "head": F.lit(True)})
    # the complement of a value is all units but those that have no other, so that no instance meets the values of others
    more, rest = F.col("values") > 1, F.col("failed") - fails
    sides = alone.unionByName(episodes).groupBy(*keys, "value").agg(
        F.sum("n").alias("selected"), F.count("*").alias("of"), F.count_if("holds").alias("kept"), F.count_if(more).alias("also"), F.count_if(more & (rest == 0)).alias("also_kept"),
        F.count_if(F.col("failed") == 0).alias("whole"), F.count_if("head").alias("heads"), F.count_if(F.col("head") & (F.col("failed") == 0)).alias("whole_heads"),
    )
    totals = sides.groupBy(*keys).agg(F.sum("selected").alias("all"), F.sum("heads").alias("units"), F.sum("whole_heads").alias("units_kept"))
    both = sides.join(vocabulary_.select("operator", "subject", "fact", "value"), ["operator", "subject", "fact", "value"], "left_semi").join(F.broadcast(totals), keys)
    both = both.select(
        *keys, "value", "selected", "of", "kept", (F.col("all") - F.col("selected")).alias("complement"), (F.col("units") - F.col("of") + F.col("also")).alias("other_of"),
        (F.col("units_kept") - F.col("whole") + F.col("also_kept")).alias("other_kept"),
    )
    floor = of_pattern(F.col("pattern"), {n: getattr(t, BY_NAME[n].floor) for n in (IMPLIES, WITHOUT, ONCE, EXACTLY, SAME)})
    enough = (F.col("selected") >= t.min_instances) & (F.col("of") >= t.min_instances) & (F.col("complement") >= t.min_instances)
    passing = both.where(enough & (F.col("kept") / F.col("of") >= floor) & (F.col("other_kept") / F.col("other_of") < floor))
    intent = (F.col("fact") == "episode.intent").cast("int")
    group = Window.partitionBy("spec", "operator")
    passing = passing.withColumn("flows", F.max(intent).over(group)).where((F.col("flows") == 0) | (intent == 1))
    order = group.orderBy(F.col("selected").desc(), "fact", "value")
    cap = F.when(F.col("flows") == 1, t.max_condition_values).otherwise(t.max_guard_rules)
    return passing.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).drop("flows", "other_of", "other_kept")


def condition_text() -> Column:
    """Of `conditions`: joined by and."""
    return F.array_join(F.transform("conditions", rendered), " and ")
