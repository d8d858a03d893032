"""What is done against what is written: confirmed, tribal and missing, in three regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import stated_conditions, strength

#: What stands for a clause without a flow.
EVERY_FLOW = "(every flow)"


def regions(rules: DataFrame, alignments: DataFrame, clauses: DataFrame, exercised: DataFrame) -> DataFrame:
    """region, kind, id, elsewhere: each live rule, and each expressible clause that no rule recovers.

    confirmed: aligned for certain; undecided: only proposed; tribal: in no clause, and `extended-beyond-policy` if a precedence clause has the
    pair of actions for another flow (elsewhere: those flows) than the rule's own, its episode.intent, else `novel`. gap: a clause that is
    violated, kept though not mined, or never exercised.
    """
    keys = ["id", "scope"]
    best = rules.select(*keys).join(alignments.select(F.col("rule").alias("id"), "scope", "kind"), keys, "left").groupBy(*keys).agg(F.max(strength(F.col("kind"))).alias("best"))
    own = F.filter(stated_conditions(rules), lambda c: c["fact"] == "episode.intent")
    pairs = rules.select(*keys, "subject", F.explode("guards").alias("guard"), F.when(F.size(own) > 0, own[0]["value"]).alias("flow"))
    flows = clauses.where("shape = 'precedence'").select("subject", "guard", F.coalesce("value", F.lit(EVERY_FLOW)).alias("of_clause")).distinct()
    found = pairs.join(F.broadcast(flows), ["subject", "guard"]).where(F.col("flow").isNull() | (F.col("flow") != F.col("of_clause")))
    places = found.groupBy(*keys).agg(F.array_sort(F.collect_set("of_clause")).alias("elsewhere"))  # as many as a policy names
    region = F.when(F.col("best") >= 2, "confirmed").when(F.col("best") == 1, "undecided").otherwise("tribal")
    tribal = region == "tribal"
    kind = F.when(tribal, F.when(F.col("elsewhere").isNotNull(), "extended-beyond-policy").otherwise("novel")).otherwise(region)
    ours = best.join(places, keys, "left").select(region.alias("region"), kind.alias("kind"), "id", F.when(tribal, F.col("elsewhere")).alias("elsewhere"))
    recovered = alignments.where("kind <> 'proposed'").select(F.col("clause").alias("id")).distinct()
    gaps = clauses.where("expressible").select("id").join(recovered, "id", "left_anti").join(exercised.withColumnRenamed("clause", "id"), "id", "left")
    why = F.when(F.coalesce("exercised", F.lit(0)) == 0, "never-exercised").when(F.col("violated") > 0, "violated").otherwise("kept-not-mined")
    silent = clauses.where("not expressible").select(F.lit("inexpressible").alias("region"), F.coalesce("reason", F.lit("")).alias("kind"), "id")
    theirs = gaps.select(F.lit("gap").alias("region"), why.alias("kind"), "id").unionByName(silent)
    return ours.unionByName(theirs, allowMissingColumns=True)


def disputed(contradictions: DataFrame, rules: DataFrame) -> DataFrame:
    """scope, a, b (ids, a < b), reason, a_text, b_text of each pair of live rules that contradict one another, once. contradictions: scope, rule_a, rule_b, reason."""
    pairs = contradictions.select("scope", F.least("rule_a", "rule_b").alias("a"), F.greatest("rule_a", "rule_b").alias("b"), "reason").groupBy("scope", "a", "b").agg(F.min("reason").alias("reason"))
    named = lambda side: rules.select("scope", F.col("id").alias(side), F.col("text").alias(f"{side}_text"))
    return pairs.join(named("a"), ["scope", "a"]).join(named("b"), ["scope", "b"]).select("scope", "a", "b", "reason", "a_text", "b_text")


def page(found: DataFrame, title: str) -> str:
    """The regions as one self-contained HTML page; for a driver, as rules a person reads are few."""
    from html import escape

    parts = []
    for region in ("confirmed", "undecided", "tribal", "gap", "inexpressible"):
        rows = found.where(F.col("region") == region).orderBy("kind", "id").collect()
        items = "".join(f"<li><b>{escape(r['kind'])}</b> {escape(r['id'])}</li>" for r in rows)
        parts.append(f"<section><h2>{region} ({len(rows)})</h2><ul>{items}</ul></section>")
    return f"<!DOCTYPE html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1>{''.join(parts)}"
