"""Rules across runs: what a new mining run does to stored rules, and what people decide about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Thresholds

KEY = ["id", "corpus", "scope"]
FIGURES = ["holds", "of"]


def merge(stored: DataFrame, mined: DataFrame, run: str, t: Thresholds = Thresholds()) -> DataFrame:
    """KEY, FIGURES, status, reason, change: stored rules after a run. Both inputs have KEY, FIGURES, status (and stored: reason).

    A person's verdict stays, with new figures, but: real retires where support is gone; not_real is proposed again where
    support moved; retired comes back where it is proposed. What isn't mined any more retires if a person could have seen it,
    and is removed otherwise (change `removed`: such rows are for the report and are not kept).
    """
    old = stored.select(*KEY, F.col("status").alias("was"), F.col("reason").alias("old_reason"), *(F.col(c).alias(f"old_{c}") for c in FIGURES))
    both = old.join(mined.select(*KEY, *FIGURES, F.col("status").alias("now")), KEY, "full_outer")
    was, now = F.col("was"), F.col("now")
    moved = F.abs(F.col("holds") / F.col("of") - F.col("old_holds") / F.col("old_of")) >= t.reproposal_delta
    gone = (was == "real") & ((F.col("of") < t.min_instances) | (now == "refused"))
    judged, seen = was.isin("real", "not_real", "narrowed"), was.isin("real", "not_real", "narrowed", "proposed")
    back = (was == "not_real") & moved | (was == "retired") & (now == "proposed")
    change = (
        F.when(was.isNull(), "inserted")
        .when(now.isNull(), F.when(seen, "retired").when(was == "retired", "untouched").otherwise("removed"))
        .when(gone, "retired")
        .when(back, "reproposed")
        .when(judged, "kept")
        .when(was == "retired", "untouched")
        .otherwise("updated")
    )
    status = F.when(change == "retired", "retired").when(change == "reproposed", "proposed").when(change.isin("kept", "untouched", "removed"), was).otherwise(now)
    reason = (
        F.when((change == "retired") & now.isNull(), f"not mined by run {run}")
        .when(change == "retired", F.concat(F.lit("support is gone in run "), F.lit(run)))
        .when(change == "reproposed", F.concat(F.lit("support changed in run "), F.lit(run)))
        .otherwise(F.col("old_reason"))
    )
    return both.select(*KEY, *(F.coalesce(c, f"old_{c}").alias(c) for c in FIGURES), status.alias("status"), reason.alias("reason"), change.alias("change"))


def adjudicate(rules: DataFrame, verdicts: DataFrame, calibrated: DataFrame | None = None) -> DataFrame:
    """rules with the last verdict (id, scope, verdict, at) of each: real, not_real or narrowed.

    A verdict real on a rule with an observed fact (obs.*) is refused, if `calibrated` (fact) hasn't that fact; such rows keep their
    status and say so in `refusal`.
    """
    last = Window.partitionBy("id", "scope").orderBy(F.col("at").desc())
    said = verdicts.withColumn("rank", F.row_number().over(last)).where("rank = 1").select("id", "scope", "verdict")
    rows = rules.join(said, ["id", "scope"], "left").withColumn("refusal", F.lit(None).cast("string"))
    if calibrated is not None and "conditions" in rules.columns:
        known = calibrated.agg(F.collect_set("fact").alias("known"))  # as many as predicates
        rows = rows.crossJoin(F.broadcast(known))
        observed = F.filter(F.transform("conditions", lambda c: c["fact"]), lambda f: f.startswith("obs."))
        blind = (F.col("verdict") == "real") & (F.size(F.array_except(observed, "known")) > 0)
        rows = rows.withColumns({"refusal": F.when(blind, "an observed fact has no calibrated predicate"), "verdict": F.when(~blind, F.col("verdict"))}).drop("known")
    return rows.withColumn("status", F.coalesce("verdict", "status")).drop("verdict")


def adjudicate_everywhere(rules: DataFrame, id_: str, verdict: str) -> tuple[DataFrame, DataFrame]:
    """(rules after one verdict at every scope where it is proposed and own, those skipped)."""
    mine, open_ = F.col("id") == id_, (F.col("status") == "proposed") & (F.col("verdict") == "own")
    return rules.withColumn("status", F.when(mine & open_, verdict).otherwise(F.col("status"))), rules.where(mine & ~open_)


def pending_narrowings(rules: DataFrame, adjudications: DataFrame) -> DataFrame:
    """pattern, subject, guards, slot, condition, parent: what people asked to be mined under a condition."""
    asked = adjudications.where("verdict = 'narrowed' and condition is not null").select("id", "condition")
    return rules.join(asked, "id").select("pattern", "subject", "guards", "slot", "condition", F.col("id").alias("parent")).distinct()


def queue(rules: DataFrame, everything: bool = False) -> DataFrame:
    """What is to be reviewed: proposed rules, of one's own evidence unless all are asked for."""
    rows = rules.where("status = 'proposed'")
    return rows if everything else rows.where("verdict = 'own'")


def load(rules: DataFrame, corpus: str | None = None, scope: str | None = None, status: list[str] | None = None, own_only: bool = False) -> DataFrame:
    rows = rules
    for column, value in (("corpus", corpus), ("scope", scope)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    rows = rows if not status else rows.where(F.col("status").isin(status))
    rows = rows.where("verdict = 'own'") if own_only else rows
    return rows.orderBy("scope", "status", (F.col("holds") / F.col("of")).desc(), F.col("of").desc(), "id")


def one(rules: DataFrame, id_: str, scope: str | None = None) -> DataFrame:
    """The rule of an id; an error if it is at several scopes and none is named."""
    rows = rules.where(F.col("id") == id_) if scope is None else rules.where((F.col("id") == id_) & (F.col("scope") == scope))
    if rows.limit(2).count() > 1:
        raise ValueError(f"{id_} is at several scopes")
    return rows


def pace(verdicts: DataFrame, least: int = 0, most: int = 600) -> DataFrame:
    """reviewer, gaps, median_seconds between consecutive verdicts (reviewer, at), of gaps in (least, most] seconds."""
    order = Window.partitionBy("reviewer").orderBy("at")
    gaps = verdicts.withColumn("gap", F.timestamp_diff("SECOND", F.lag("at").over(order), F.col("at")))
    return gaps.where((F.col("gap") > least) & (F.col("gap") <= most)).groupBy("reviewer").agg(F.count("*").alias("gaps"), F.median("gap").alias("median_seconds"))
