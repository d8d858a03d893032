"""Rules among rules: contradictions, implied rules, rules that nothing could have violated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..reuse import written
from .patterns import EXACTLY, IMPLIES, SAME, VACUOUS_CONTACT, WITHOUT

#: What must be alike for two rules to speak of the same situation.
SITUATION = ["operator", "window", "condition_key"]


def contradictions(rules: DataFrame) -> DataFrame:
    """operator, a, b (ids, a < b), subject, guard: pairs of precedence rules that each require the other's subject first.

    rules: id, operator, pattern, window, condition_key, subject, guards, slot. Rules of several guards take no part.
    """
    sole = rules.where(F.col("pattern").isin(IMPLIES, WITHOUT, SAME) & (F.size("guards") == 1)).withColumn("guard", F.col("guards")[0])
    keys = [*SITUATION, "pattern"]
    left = sole.select(*keys, F.coalesce("slot", F.lit("")).alias("slot"), F.col("id").alias("a"), "subject", "guard")
    right = sole.select(*keys, F.coalesce("slot", F.lit("")).alias("slot"), F.col("id").alias("b"), F.col("guard").alias("subject"), F.col("subject").alias("guard"))
    return left.join(right, [*keys, "slot", "subject", "guard"]).where("a < b").select("operator", "a", "b", "subject", "guard")


def implied(rules: DataFrame) -> DataFrame:
    """operator, id, by (ids): rules that others imply, once over the given rules and not until nothing changes.

    A contact's rule by the episode's of the same guard, else by one on the same slot with that one guard; exactly-one
    by the plain one; X after Y by X after Z and Z after Y, the least Z first.
    """
    first = F.col("guards")[0]
    plain = rules.where(F.col("pattern") == IMPLIES).select("operator", "condition_key", "subject", first.alias("guard"), F.col("id").alias("by"))
    keys = ["operator", "condition_key", "subject", "guard"]

    def those(pattern: str) -> DataFrame:
        return rules.where(F.col("pattern") == pattern).select("operator", "condition_key", "subject", first.alias("guard"), "id", "window")

    twins = those(WITHOUT).join(plain, keys).select("operator", "id", F.array("by").alias("by"))
    narrow = rules.where((F.col("pattern") == SAME) & (F.size("guards") == 1)).groupBy("operator", "condition_key", "subject", first.alias("guard")).agg(F.min("id").alias("by"))
    slots = those(WITHOUT).join(twins.select("operator", "id"), ["operator", "id"], "left_anti").join(narrow, keys).select("operator", "id", F.array("by").alias("by"))
    exact = those(EXACTLY).join(plain, keys).select("operator", "id", F.array("by").alias("by"))
    one = plain.select("operator", "condition_key", "subject", F.col("guard").alias("z"), F.col("by").alias("by1"))
    two = plain.select("operator", "condition_key", F.col("subject").alias("z"), "guard", F.col("by").alias("by2"))
    ways = those(IMPLIES).join(one, ["operator", "condition_key", "subject"]).where("z <> guard").join(two, ["operator", "condition_key", "z", "guard"])
    order = Window.partitionBy("operator", "id").orderBy("z")
    chain = ways.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("operator", "id", F.array("by1", "by2").alias("by"))
    return twins.unionByName(slots).unionByName(exact).unionByName(chain)


def settle(rules: DataFrame) -> DataFrame:
    """rules with status, reason, suppressed_by after contradictions, then implied rules, then those never in question.

    rules: as contradictions() takes, with status, reason, holds, of. Only proposed ones take part.
    """
    rules = written(rules)
    proposed = rules.where("status = 'proposed'")
    cycles = contradictions(proposed)
    both = cycles.select("operator", F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("cycle", F.lit(True))
    left = rules.join(both, ["operator", "id"], "left").withColumn("status", F.when(F.col("cycle"), "contradicted").otherwise(F.col("status")))
    left = left.withColumn("reason", F.when(F.col("cycle"), "precedence cycle: each requires the other first").otherwise(F.col("reason"))).drop("cycle")
    left = written(left)
    by = implied(left.where("status = 'proposed'")).withColumnRenamed("by", "suppressed_by")
    left = left.join(by, ["operator", "id"], "left")
    hit = (F.col("status") == "proposed") & F.col("suppressed_by").isNotNull()
    left = left.withColumns({"reason": F.when(hit, F.concat(F.lit("implied by "), F.array_join("suppressed_by", ", "))).otherwise(F.col("reason")), "status": F.when(hit, "suppressed").otherwise(F.col("status"))})
    never = (F.col("status") == "proposed") & (F.col("pattern") == WITHOUT) & (F.col("corpus_holds") == F.col("corpus_of"))
    return left.withColumns({"reason": F.when(never, VACUOUS_CONTACT).otherwise(F.col("reason")), "status": F.when(never, "suppressed").otherwise(F.col("status"))})
