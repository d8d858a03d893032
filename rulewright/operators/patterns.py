"""The obligation patterns: which rules are worth measuring, and whether each instance keeps them.

A spec is a rule to measure: spec (its key), pattern, subject, guards (array, empty for none), slot, conditions. A
check is a spec at an instance, with `holds`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logic import NO_CONDITIONS, all_of
from ..schema import Thresholds
from .instances import ACTOR, KEY, earlier, firsts, slot_firsts, slot_values, with_firsts

IMPLIES, WITHOUT, ONCE, EXACTLY, SAME = "X-implies-prior-Y", "no-X-without-prior-Y", "at-most-one-X", "exactly-one-Y-per-X", "no-X-without-prior-Y-same-S"
VACUOUS_EPISODE = "nothing to learn: the corpus has no episode in which this could fail"
VACUOUS_CONTACT = "nothing to learn: in all contacts with this action the guard was there already"


@dataclass(frozen=True)
class Pattern:
    """A row of the table of patterns; floor: the threshold that a proposed rule's support must reach."""

    name: str
    window: str
    per_episode: bool
    floor: str
    text: str  # of {x}, {y} (guards, joined by "or"), {s}
    why: str
    predicate: str  # Spark SQL over a row of summaries


PATTERNS = (
    Pattern(IMPLIES, "episode", False, "implies_support", "{X} only after this episode has had: {y}.", "episodes with this action had {y} ahead of it", "first_in_episode['{Y}'] < seq"),
    Pattern(WITHOUT, "interaction", False, "own_support", "{X} only after the contact, in this episode or an older one, has had: {y}.", "contacts with this action mostly had {y} ahead of it", "first_in_contact['{Y}'] < seq"),
    Pattern(ONCE, "episode", True, "implies_support", "No episode has this twice: {x}.", "episodes that did this did it one time", "times_in_episode['{X_type}'] <= 1"),
    Pattern(EXACTLY, "episode", True, "implies_support", "An episode with {x} has {y} one time, neither more nor less.", "episodes with this action counted one {y}", "times_in_episode['{Y}'] = 1"),
    Pattern(SAME, "interaction", False, "own_support", "{X} only for a {s} that the contact has seen in: {y}.", "mostly the {s} had been in {y} ahead of it", "first_on_same_{s}['{Y}'] < seq"),
)
BY_NAME = {p.name: p for p in PATTERNS}


def of_pattern(column: Column, values: dict[str, object]) -> Column:
    """By pattern name, a literal."""
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(column == name, F.lit(value)).otherwise(out)
    return out


def guard_stats(found: DataFrame, events: DataFrame, scope: str, by: tuple[str, ...] = ("operator",)) -> DataFrame:
    """by, subject, guard, n (instances with an earlier guard), instances, share, rank (1 is the largest share)."""
    keys = [*by, "subject"]
    total = found.groupBy(*keys).agg(F.count("*").alias("instances"))
    seen = earlier(found, events, scope).groupBy(*keys, "guard").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "guard")
    return seen.join(total, keys).withColumns({"share": F.col("n") / F.col("instances"), "rank": F.row_number().over(order)})


def same_slot_stats(found: DataFrame, events: DataFrame, alphabet: DataFrame, by: tuple[str, ...] = ("operator",)) -> tuple[DataFrame, DataFrame]:
    """Guards on the same slot value: by, subject, slot, guard, n; and by, subject, slot, instances, valued, covered."""
    keys = [*by, "subject", "slot"]
    rows = slot_values(found)
    met = rows.join(slot_firsts(events, alphabet), ["interaction", "slot", "value"]).where("first < seq and guard <> subject")
    guards = met.groupBy(*keys, "guard").agg(F.count("*").alias("n"))
    covered = met.select(*keys, *KEY).distinct().groupBy(*keys).agg(F.count("*").alias("covered"))
    total = rows.groupBy(*keys).agg(F.count("*").alias("instances"), F.count("value").alias("valued"))
    return guards, total.join(covered, keys)


def spec_key() -> Column:
    conditions = F.transform("conditions", lambda c: F.concat_ws(":", c["fact"], c["op"], F.array_join(c["values"], ",")))
    return F.concat_ws("|", "pattern", "subject", F.array_join("guards", "+"), F.coalesce("slot", F.lit("")), F.array_join(F.array_sort(conditions), "&"))


def ranked(found: DataFrame, events: DataFrame, alphabet: DataFrame) -> DataFrame:
    """operator, pattern, subject, slot, guard, n, instances, covered (share on a slot, else null), rank: all that could be a rule, before any threshold.

    A rank is among guards in the order of n, so that a floor of n or of its share takes the first ranks only, whichever it is.
    """
    nothing, keys = F.lit(None), ["operator", "subject"]

    def shaped(rows: DataFrame, pattern: str, slot: Column = nothing, covered: Column = nothing) -> DataFrame:
        guard = F.col("guard") if "guard" in rows.columns else nothing
        return rows.select("operator", F.lit(pattern).alias("pattern"), "subject", slot.cast("string").alias("slot"), guard.cast("string").alias("guard"), "n", "instances", covered.cast("double").alias("covered"), "rank")

    episode, contact = guard_stats(found, events, "episode"), guard_stats(found, events, "interaction")
    # exactly one: never twice in an episode of the subject
    most = found.select(*keys, "episode").distinct().join(firsts(events, "episode"), "episode").groupBy(*keys, "guard").agg(F.max("times").alias("most"))
    again = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "guard")
    single = episode.join(most.where("most <= 1"), [*keys, "guard"]).withColumn("rank", F.row_number().over(again))
    alone = found.groupBy(*keys).agg(F.count("*").alias("instances")).withColumns({"n": F.col("instances"), "rank": F.lit(1)})
    guards, totals = same_slot_stats(found, events, alphabet)
    best = Window.partitionBy(*keys, "slot").orderBy(F.col("n").desc(), "guard")
    slots = guards.withColumn("rank", F.row_number().over(best)).join(totals.where("valued = instances"), [*keys, "slot"])
    out = shaped(episode, IMPLIES)
    for more in (shaped(contact, WITHOUT), shaped(alone, ONCE), shaped(single, EXACTLY), shaped(slots, SAME, F.col("slot"), F.col("covered") / F.col("instances"))):
        out = out.unionByName(more)
    return out


def suggested(rows: DataFrame, t: Thresholds, also: tuple[str, ...] = ()) -> DataFrame:
    """also, operator and the specs that its own history suggests, without conditions; rows: ranked(). Thresholds may be columns, then of the sets `also` names."""
    share, pattern = F.col("n") / F.col("instances"), F.col("pattern")
    enough = (F.col("instances") >= t.min_instances) & (F.col("rank") <= t.max_guard_rules)
    often = (
        F.when(pattern.isin(IMPLIES, WITHOUT), share >= t.guard_support)
        .when(pattern == EXACTLY, share >= t.implies_support)
        .when(pattern == SAME, (F.col("covered") >= t.guard_support) & (F.col("n") >= t.min_instances))
        .otherwise(True)
    )
    kept, keys = rows.where(enough & often), [*also, "operator", "pattern", "subject", "slot"]
    one = kept.where(pattern != SAME).select(*keys, F.when(F.col("guard").isNull(), F.array().cast("array<string>")).otherwise(F.array("guard")).alias("guards"))
    sets = kept.where(pattern == SAME).groupBy(*keys).agg(F.array_sort(F.collect_list("guard")).alias("guards"))
    return one.unionByName(sets).withColumn("conditions", F.expr(NO_CONDITIONS))


def candidates(found: DataFrame, events: DataFrame, alphabet: DataFrame, t: Thresholds) -> DataFrame:
    """operator and the specs that its own history suggests, without conditions."""
    return suggested(ranked(found, events, alphabet), t)


def union_of(specs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """One spec for all operators that suggest it; guard sets on one slot are united."""
    sets = F.array_sort(F.array_distinct(F.flatten(F.collect_list("guards"))))
    united = specs.where(F.col("pattern") == SAME).groupBy(*also, "pattern", "subject", "slot", "conditions").agg(sets.alias("guards"))
    others = specs.where(F.col("pattern") != SAME).select(*also, "pattern", "subject", "guards", "slot", "conditions").distinct()
    return others.unionByName(united).withColumn("spec", spec_key())


def checks(found: DataFrame, specs: DataFrame, events: DataFrame, alphabet: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """spec, pattern, KEY, ACTOR, holds, keep: each spec at each instance of its subject for which its conditions are true.

    found has facts (a map) if specs have conditions. keep: columns of found that stay. An instance meets what came before it once, as maps
    of its episode and contact, and only then its specs, so that no row of an instance and a spec is shuffled but for specs on the same object.
    """
    cols = [*KEY, *ACTOR, "subject", "slots", *(["facts"] if "facts" in found.columns else [])]
    out = [*KEY, *ACTOR, *keep, F.coalesce("holds", F.lit(False)).alias("holds")]

    def met(rows: DataFrame, of: Column, *more: str) -> DataFrame:
        """rows (with what `more` names) at the specs `of`."""
        asked = specs.where(of)
        rows = rows.select(*cols, *more)
        if "facts" not in cols:
            return rows.join(F.broadcast(asked), "subject")  # specs are few: a handful for each pair of action types
        # the first equality is a key of the join, so that an instance meets specs of its own facts and not those of all values
        first = F.get("conditions", F.lit(0))
        equal = (first["op"] == "eq") & (F.size(first["values"]) == 1)
        asked = asked.withColumns({"fact": F.when(equal, first["fact"]), "value": F.when(equal, first["values"][0])})
        none = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
        told = F.filter(F.coalesce(F.map_entries("facts"), F.array()), lambda e: e["value"].isNotNull())
        same = (F.col("r.subject") == F.col("s.subject")) & F.col("r.known.key").eqNullSafe(F.col("s.fact")) & F.col("r.known.value").eqNullSafe(F.col("s.value"))
        rows = rows.withColumn("known", F.explode(F.concat(none, told))).alias("r").join(F.broadcast(asked).alias("s"), same)
        rows = rows.select("r.*", *(f"s.{c}" for c in specs.columns if c != "subject")).drop("known")
        return rows.where((F.size("conditions") == 0) | all_of(F.col("conditions"), F.col("facts")))

    known = with_firsts(found, firsts(events, "episode"), firsts(events, "interaction"))
    rows = met(known, F.col("pattern") != SAME, "in_episode", "in_contact")
    guard, earlier_ = F.coalesce(F.get("guards", F.lit(0)), F.col("subject")), lambda of: of["first"] < F.col("seq")
    here, times = F.col("in_episode")[guard], F.col("in_episode")[guard]["times"]
    kept = F.when(F.col("pattern") == IMPLIES, earlier_(here)).when(F.col("pattern") == WITHOUT, earlier_(F.col("in_contact")[guard])).when(F.col("pattern") == ONCE, times <= 1).when(F.col("pattern") == EXACTLY, times == 1)
    rows = rows.withColumn("holds", kept).select("spec", "pattern", *out)
    if specs.where(F.col("pattern") == SAME).isEmpty():
        return rows
    same = met(found, F.col("pattern") == SAME).where(F.size("guards") > 0).withColumn("value", F.element_at("slots", F.col("slot")))
    on_same = slot_firsts(events, alphabet).groupBy("interaction", "slot", "value").agg(F.map_from_entries(F.collect_list(F.struct("guard", "first"))).alias("on_same"))
    same = same.join(on_same, ["interaction", "slot", "value"], "left")
    before = F.exists("guards", lambda g: F.coalesce(F.col("on_same")[g] < F.col("seq"), F.lit(False)))
    return rows.unionByName(same.withColumn("holds", before).select("spec", "pattern", *out))


def measured(checked: DataFrame, failing: bool = True) -> DataFrame:
    """spec, pattern, operator, level (operator, team, agent), scope, holds, of, n, failing.

    Patterns of episodes count an episode once, as failing if any of its instances fails. n counts instances.
    failing: an interaction that doesn't keep it, the least of them; left out if not asked for.
    """
    once, rule = F.col("pattern").isin([p.name for p in PATTERNS if p.per_episode]), ["spec", "pattern"]
    units = checked.where(once).groupBy(*rule, *ACTOR, "interaction", "episode").agg(F.bool_and("holds").alias("holds"), F.count("*").alias("n")).drop("episode")
    units = checked.where(~once).select(*rule, *ACTOR, "interaction", "holds", F.lit(1).cast("long").alias("n")).unionByName(units)  # an instance is a unit
    counts = [F.count_if("holds").alias("holds"), F.count("*").alias("of"), F.sum("n").alias("n")]
    sums, least = [F.sum(c).alias(c) for c in ("holds", "of", "n")], [F.min("failing").alias("failing")] if failing else []
    if failing:  # counted by contact first: a least string takes a sort of the rows it is taken of
        units = units.groupBy(*rule, *ACTOR, "interaction").agg(*counts).withColumn("failing", F.when(F.col("holds") < F.col("of"), F.col("interaction")))
    actors = units.groupBy(*rule, *ACTOR).agg(*(sums if failing else counts), *least)
    levels = F.explode(F.array(*(F.struct(F.lit(level).alias("level"), F.col(level).alias("scope")) for level in ACTOR)))
    at = actors.withColumn("at", levels).select("*", "at.*").where("scope is not null")
    return at.groupBy(*rule, "operator", "level", "scope").agg(*sums, *least)


def counterexamples(checked: DataFrame, most: int) -> DataFrame:
    """spec, operator, interaction, episode, seq: at most `most` failing instances of each, in order."""
    order = Window.partitionBy("spec", "operator").orderBy(*KEY)
    return checked.where("not holds").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("spec", "operator", *KEY)
