"""Text predicates: sites, one call for each different redacted text, bands, calibration, drift.

A predicate: pred, fact (obs.*), window (event.text, episode.text, slot.<name>), pattern, assert_at, refute_at. The
observer is a function of (text, predicates) to a probability; the one here matches a pattern and is repeatable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import short_hash
from ..functions.text import redact_text
from ..schema import Thresholds


def sites(events: DataFrame, predicates: DataFrame) -> DataFrame:
    """interaction, episode, seq, pred, text, sha of every event that a predicate can look at; blank texts can't be.

    episode.text is what was said in the episode up to the event.
    """
    so_far = Window.partitionBy("episode").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("said", F.array_join(F.collect_list("text").over(so_far), "\n"))
    rows = rows.join(F.broadcast(predicates.select("pred", "window")), F.lit(True))  # a few predicates
    slot = F.element_at("slots", F.regexp_replace("window", "^slot[.]", "")) if "slots" in events.columns else F.lit(None).cast("string")
    text = F.when(F.col("window") == "event.text", F.col("text")).when(F.col("window") == "episode.text", F.col("said")).otherwise(slot)
    rows = rows.withColumn("text", redact_text(text)).where(F.length(F.trim("text")) > 0)
    return rows.select("interaction", "episode", "seq", "pred", "text", short_hash(F.col("text")).alias("sha"))


def calls(found: DataFrame, budget: int | None = None) -> DataFrame:
    """sha, text, pred, sites: the different texts that are asked about; with a budget, the first of them by sha."""
    asked = found.groupBy("sha", "pred").agg(F.min("text").alias("text"), F.count("*").alias("sites"))
    if budget is not None:
        taken = asked.select("sha").distinct().orderBy("sha").limit(budget)
        asked = asked.join(taken, "sha", "left_semi")
    return asked


def pattern_observer(text: Column, pattern: Column) -> Column:
    """1 where the predicate's pattern is met, with 0.6 for half-matches of its first word, else 0.05."""
    word = F.regexp_extract(F.regexp_replace(pattern, r"\\[a-zA-Z]", " "), r"\w+", 0)  # \b and the like are no letters
    return F.when(F.regexp_like(text, pattern), 0.97).when((word != "") & F.contains(F.lower(text), F.lower(word)), 0.6).otherwise(0.05)


def observe(asked: DataFrame, predicates: DataFrame, observer: Callable[[Column, Column], Column] = pattern_observer) -> DataFrame:
    """sha, pred, p."""
    return asked.join(F.broadcast(predicates.select("pred", "pattern")), "pred").select("sha", "pred", F.round(observer(F.col("text"), F.col("pattern")), 2).alias("p"))


def band(p: Column, assert_at: Column, refute_at: Column) -> Column:
    """'true', 'false', or null where the observer isn't sure enough."""
    return F.when(p >= assert_at, "true").when(p <= refute_at, "false")


def annotations(found: DataFrame, observed: DataFrame, predicates: DataFrame) -> DataFrame:
    """interaction, episode, seq, pred, fact, p, value at every site; withheld ones too, with null."""
    rows = found.join(observed, ["sha", "pred"]).join(F.broadcast(predicates.select("pred", "fact", "assert_at", "refute_at")), "pred")
    return rows.select("interaction", "episode", "seq", "pred", "fact", "p", band(F.col("p"), F.col("assert_at"), F.col("refute_at")).alias("value"), "sha")


def digest(lines: DataFrame) -> str:
    """16 digits for a set of annotations: of each pred's own digest, so that no task holds all lines."""
    line = F.concat_ws("\t", "interaction", "episode", F.col("seq").cast("string"), "pred", F.col("p").cast("string"), F.coalesce("value", F.lit("")))
    parts = lines.select(F.xxhash64(line).cast("decimal(38,0)").alias("h"), "pred").groupBy("pred").agg(F.sum("h").alias("h"), F.count("*").alias("n"))
    text = ";".join(f"{r['pred']}:{r['h']}:{r['n']}" for r in parts.orderBy("pred").collect())  # a row for each predicate
    from hashlib import sha256

    return sha256(text.encode()).hexdigest()[:16]


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """pred, shared, changed, moved, only_before, only_after."""
    keys = ["interaction", "episode", "seq", "pred"]
    both = before.select(*keys, F.col("value").alias("v1"), F.col("p").alias("p1"), F.lit(1).alias("b")).join(after.select(*keys, F.col("value").alias("v2"), F.col("p").alias("p2"), F.lit(1).alias("a")), keys, "full_outer")
    shared = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.groupBy("pred").agg(
        F.count_if(shared).alias("shared"), F.count_if(shared & ~F.col("v1").eqNullSafe(F.col("v2"))).alias("changed"), F.count_if(shared & (F.col("p1") != F.col("p2"))).alias("moved"),
        F.count_if(F.col("a").isNull()).alias("only_before"), F.count_if(F.col("b").isNull()).alias("only_after"),
    )


def active(predicates: DataFrame, corpus_revision: str, alphabet_version: int) -> tuple[DataFrame, DataFrame]:
    """(predicates that may be asked, the others with why): real, calibrated, and for this corpus and alphabet."""
    why = (
        F.when(F.col("status") != "real", "not adjudicated")
        .when(F.col("assert_at").isNull(), "not calibrated")
        .when(F.col("corpus_revision") != corpus_revision, "the corpus moved")
        .when(F.col("alphabet_version") != alphabet_version, "the alphabet moved")
    )
    rows = predicates.withColumn("why", why)
    return rows.where("why is null").drop("why"), rows.where("why is not null")


#: An edge keeps so many hundredths from a mode, which is a p of at least one in MODE answers.
NEAR, MODE = 2, 10


def observed_distribution(labelled: DataFrame) -> DataFrame:
    """pred, label (yes, no, unsure), p (in hundredths; null where none was given), n: what an observer said of what people labelled, and how often they weren't sure."""
    label = F.when(F.col("label").isNull(), "unsure").when(F.col("label"), "yes").otherwise("no")
    return labelled.groupBy("pred", label.alias("label"), F.round("p", 2).alias("p")).agg(F.count("*").alias("n"))


def derive_bands(labelled: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """pred, assert_at, refute_at, problem of labelled answers (pred, p, label: boolean, null if unsure).

    A grid of hundredths: assert_at is the least p from which labels are true often enough, refute_at the largest up to which
    they are false often enough. Refused first if the labels' mean p lie too near, then for too few labels. No edge lies within
    NEAR hundredths of a mode, a p that a MODEth of the predicate's answers have, as a small change of the observer would move them all across it.
    """
    sure = labelled.where("label is not null").withColumn("q", F.round(F.col("p") * 100).cast("int"))
    size = sure.groupBy("pred").agg(F.count("*").alias("n"), F.count_if("label").alias("yes"), (F.avg(F.when(F.col("label"), F.col("p"))) - F.avg(F.when(~F.col("label"), F.col("p")))).alias("apart"))
    steps = sure.select("pred", "q", "label").withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(100))))
    counts = steps.groupBy("pred", "at").agg(
        F.count_if(F.col("q") >= F.col("at")).alias("above"), F.count_if((F.col("q") >= F.col("at")) & F.col("label")).alias("true_above"),
        F.count_if(F.col("q") <= F.col("at")).alias("below"), F.count_if((F.col("q") <= F.col("at")) & ~F.col("label")).alias("false_below"),
    )
    sharp = t.min_predicate_precision
    every = Window.partitionBy("pred")  # a row for each hundredth
    modes = sure.groupBy("pred", "q").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(every)).where(F.col("n") * MODE >= F.col("all"))
    close = modes.select("pred", F.explode(F.sequence(F.col("q") - NEAR, F.col("q") + NEAR)).alias("at")).distinct()
    counts = counts.join(close, ["pred", "at"], "left_anti")
    edges = counts.groupBy("pred").agg(
        F.min(F.when((F.col("above") > 0) & (F.col("true_above") / F.nullif("above", F.lit(0)) >= sharp), F.col("at"))).alias("up"),
        F.max(F.when((F.col("below") > 0) & (F.col("false_below") / F.nullif("below", F.lit(0)) >= sharp), F.col("at"))).alias("down"),
    )
    few = (F.col("n") < t.min_calibration) | (F.col("yes") < t.min_label) | (F.col("n") - F.col("yes") < t.min_label)
    problem = F.when(F.coalesce("apart", F.lit(0.0)) < t.min_label_separation, "labels not separated").when(few, "too few labels").when(F.col("up").isNull(), "not precise anywhere")
    wide = F.col("up") - F.col("down") >= 20
    return size.join(edges, "pred", "left").select("pred", F.when(problem.isNull(), F.col("up") / 100).alias("assert_at"), F.when(problem.isNull() & wide, F.col("down") / 100).alias("refute_at"), problem.alias("problem"))


def calibration_progress(sample: DataFrame) -> DataFrame:
    """pred, total, labelled, yes, no, unsure of a sample (pred, label, asked)."""
    return sample.groupBy("pred").agg(F.count("*").alias("total"), F.count("label").alias("labelled"), F.count_if("label").alias("yes"), F.count_if(~F.col("label")).alias("no"), F.count_if(F.col("asked") & F.col("label").isNull()).alias("unsure"))
