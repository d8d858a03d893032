"""Where a rule is from: kept here (by the operator, a team or an agent), kept elsewhere, or nowhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Thresholds


def own(holds: Column, of: Column, t: Thresholds) -> Column:
    """The classifier: enough instances, and support of at least own_support."""
    return (of >= t.min_instances) & (holds / of >= t.own_support)


def verdicts(support: DataFrame, t: Thresholds, classify=own, also: tuple[str, ...] = ()) -> DataFrame:
    """spec, pattern, operator, verdict (own, borrowed, neither), level, scope, found_in, holds, of, corpus_holds, corpus_of.

    support: as patterns.measured gives it. The first of the operator, its teams and its agents (those of most instances
    first) that classify calls own is the scope of the rule, and its figures are the rule's. Otherwise it is borrowed
    if enough other operators keep it. also: columns of support that tell rules apart, beside the spec, and stay.
    """
    rule = [*also, "spec"]
    rank = F.when(F.col("level") == "operator", 0).when(F.col("level") == "team", 1).otherwise(2)
    here = Window.partitionBy(*rule, "operator").orderBy(rank, F.col("n").desc(), "scope")
    level = support.where(classify(F.col("holds"), F.col("of"), t)).withColumn("rank", F.row_number().over(here)).where("rank = 1")
    whole = support.where("level = 'operator'").where(F.col("n") >= t.min_instances)
    whole = whole.select(*rule, "pattern", "operator", F.col("holds").alias("corpus_holds"), F.col("of").alias("corpus_of"), "failing")
    keeping = whole.where((F.col("corpus_of") >= t.min_instances) & (F.col("corpus_holds") / F.col("corpus_of") >= t.own_support))
    keepers = keeping.groupBy(*rule).agg(F.array_sort(F.collect_list("operator")).alias("keepers"))  # as many as operators
    out = whole.join(level.select(*rule, "operator", "level", "scope", "holds", "of"), [*rule, "operator"], "left").join(keepers, rule, "left")
    elsewhere = F.array_remove(F.coalesce("keepers", F.array().cast("array<string>")), F.col("operator"))
    verdict = F.when(F.col("level").isNotNull(), "own").when(F.size(elsewhere) >= t.borrowed_operators, "borrowed").otherwise("neither")
    return out.select(
        *rule, "pattern", "operator", verdict.alias("verdict"), "level", "scope", F.when(verdict == "borrowed", elsewhere).alias("found_in"),
        F.coalesce("holds", "corpus_holds").alias("holds"), F.coalesce("of", "corpus_of").alias("of"), "corpus_holds", "corpus_of", "failing",
    )


def evidence(why: Column) -> Column:
    """What a reviewer reads beside a rule: its figures, where they are from, and what speaks for it."""
    counted = F.format_string("kept in %d of %d cases", "holds", "of")
    narrower = F.when(F.col("level") != "operator", F.format_string(" of %s %s; in all of the operator %d of %d", "level", "scope", "corpus_holds", "corpus_of"))
    others = F.format_string("seen at %d more operator(s), here ", F.size("found_in"))
    own = F.concat(counted, F.coalesce(narrower, F.lit("")), F.lit(": "), why)
    return F.when(F.col("verdict") == "own", own).when(F.col("verdict") == "borrowed", F.concat(others, counted)).otherwise(F.concat(F.lit("seen at no operator, here "), counted))
