"""Vectors that a search can use, and the best of what its tasks found."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, may_be_zero: bool) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part.

    Not those without vec_id or vector, nor with a null or non-finite component, nor, unless asked for, zero or
    empty ones. Equal rows are one.
    """
    x = F.col("vector")
    size = F.lit(float("inf"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < size))
    if not may_be_zero:
        fine &= F.exists(x, lambda v: v != 0)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine).distinct()


def stacked(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, width))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, largest first, ties by smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def merged(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best different rows of each query."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    rows = found.select("query_id", "vec_id", "score").distinct()
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
