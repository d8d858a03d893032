"""Mixing sources to target weights: how often each document is taken so that sources get their shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, running_totals, written

#: Weights of sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A source is used at most so many times over.
MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """From 1 to 2, for weights: 1, and the share of characters that are ASCII letters or not ASCII or white space."""
    plain = F.length(F.translate(text, "0123456789!\"#$%&()*+/:;<=>?@[\\]^_`{|}~", ""))
    return F.coalesce(1 + plain / F.nullif(F.length(text), F.lit(0)), F.lit(1.0))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size -> also weight and target; a row for each source.

    Targets share the sum of all sizes by weight. One that would be over `most` times its source's size stops
    there, and what is over is shared anew. Equivalently: in the order of most * size / weight, sources are full
    up to the first at which the level (what is left for a unit of weight) is below its own stop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    known = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), rank + 1).cast("long"))
    known = known.withColumn("stop", most * F.col("source_size"))
    order = (F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here_on = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("stop").over(earlier), F.lit(0))
    known = known.withColumns({"left": left, "heft": F.sum("weight").over(here_on)})
    known = known.withColumn("full", F.col("stop") * F.col("heft") < F.col("left") * F.col("weight"))
    open_ = ~F.col("full")  # full ones come first
    level = {k: F.max_by(k, F.when(open_, F.col("heft"))).over(Window.partitionBy()) for k in ("left", "heft")}
    known = known.withColumns({f"{k}_open": v for k, v in level.items()})
    target = F.when(F.col("full"), F.col("stop").cast("double")).otherwise(F.col("weight") * F.col("left_open") / F.col("heft_open"))
    return known.select("source", "source_size", "weight", target.alias("target"))


def sampling_key(doc_id: Column, text: Column, quality: Column, seed: int) -> Column:
    """Efraimidis and Spirakis: the smallest of exponential variates divided by weights are a weighted sample.

    The variate comes from an md5 of seed and doc_id, or of the text where there is none, so that it is the same in every run.
    """
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), name)), 1, 12)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(uniform) / quality


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, row: str | None = None) -> DataFrame:
    """doc_id, size (words), source, source_size, target, copies and taken (words: size * copies) of every row of docs.

    A source gets as many complete epochs as its target holds. What is left of the target is filled by documents
    in the order of their keys, each whole: those whose middle lies before the end of the budget. Rows without
    words take nothing. Null sources are a source; rows without doc_id are told apart by their text; repeated rows have the same key and
    follow one another, each counted for itself; an empty table gives an empty one; other columns of docs play no part. row: a column of docs
    that tells its rows apart, returned as `row`.
    """
    text, own = F.col("text"), [F.col(row).alias("row")] if row else []
    rows = written(
        docs.select(*own, "doc_id", "source", word_count(text).alias("size"), sampling_key(F.col("doc_id"), text, text_quality(text), seed).alias("key"), F.xxhash64("text").alias("content"))
    )
    plan = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    total = running_totals(rows, [F.col("source").asc_nulls_last(), "key", "doc_id", "size", "content", *(["row"] if row else [])], "size")
    earlier = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("first", F.coalesce(F.sum("source_size").over(earlier), F.lit(0)))
    plan = plan.withColumnRenamed("source", "name")
    joined = total.join(plan, F.col("source").eqNullSafe(F.col("name")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    joined = joined.withColumn("epochs", epochs.cast("long"))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    more = (F.col("size") > 0) & (F.col("before") - F.col("first") + F.col("size") / 2 <= rest)
    copies = F.least(F.when(F.col("size") > 0, F.col("epochs") + more.cast("long")).otherwise(0), F.lit(most))
    return joined.withColumn("copies", copies).select(
        *(["row"] if row else []), "doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed_documents(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """docs with each row as often as the mix takes it, also where rows have no doc_id or one that others have."""
    row, copies, taken_row = (fresh(docs, n) for n in ("row", "copies", "taken_row"))
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()))
    taken = mix(rows, seed, weights, most, row).where("copies > 0").select(F.col("row").alias(taken_row), F.col("copies").alias(copies))
    often = rows.join(taken, F.col(row) == F.col(taken_row)).drop(row, taken_row)
    each = fresh(docs, "each")
    return often.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(each, copies)
