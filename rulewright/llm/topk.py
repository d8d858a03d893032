"""Exact search for the largest inner products, in buckets of vectors of like length.

Candidates are sorted by length and cut into buckets. The bucket of the longest gives each query a first threshold, its
k-th best score there. For each further bucket a query has a local threshold, the cosine that a vector as long as
the bucket's longest needs to reach it. Over 1, the bucket can't hold a result and the query isn't sent there. A low one makes
lengths decide: only the bucket's vectors that are long enough are multiplied. A high one makes coordinates
decide: a vector at a small angle has nearly the query's large coordinates, and sorted coordinates give a range of
candidates. Either way, products settle what is left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_totals, written
from .vectors import best, merged, stacked, usable

BUCKET, BLOCK = 4096, 1024
#: The local cosine from which on coordinates prune; the coordinates of a query that do.
ANGLED, FOCUS = 0.8, 3
SLACK = 1e-9


def candidates_of(q: np.ndarray, length: float, wanted: float, vectors: np.ndarray, lengths: np.ndarray, unit: np.ndarray, order: np.ndarray) -> np.ndarray | slice:
    """Places of the bucket's vectors (longest first) whose product with q may reach `wanted`.

    unit: the vectors at length 1; order: for each coordinate, their places sorted by it.
    """
    if not length or wanted == -np.inf:
        return slice(None)
    if wanted > 0:
        long_enough = int(np.searchsorted(-lengths, -(wanted / length) * (1 - SLACK), side="right"))
    else:
        long_enough = len(lengths)
    cosine = wanted / (length * lengths[0]) if lengths[0] else 0.0
    if cosine < ANGLED:
        return slice(0, long_enough)
    # cos >= c needs |p_f - q_f c'| <= ... : p_f between q_f c - s and q_f c + s for the least cosine c, or beyond q_f
    c, along = min(1.0, cosine), q / length
    kept = None
    for f in np.argsort(-np.abs(along))[:FOCUS]:
        s = np.sqrt(max(0.0, 1 - c * c) * max(0.0, 1 - along[f] ** 2))
        low = along[f] * c - s if along[f] > -c else -1.0
        high = along[f] * c + s if along[f] < c else 1.0
        if kept is None:
            values = unit[order[f], f]
            a, b = np.searchsorted(values, (low - 1e-7, high + 1e-7))
            kept = order[f][a:b]
        else:
            kept = kept[(unit[kept, f] >= low - 1e-7) & (unit[kept, f] <= high + 1e-7)]
    return kept[kept < long_enough]


def search_block(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """One block of queries in one bucket: each query's k best there that may be among its k best of all."""
    asks, has = rows[rows["wanted"].notna()], rows[rows["wanted"].isna()].sort_values(["size", "vec_id"], ascending=[False, True])
    width = len(rows["vector"].iloc[0])
    vectors, ids = stacked(has["vector"], width), has["vec_id"].to_numpy()
    queries = stacked(asks["vector"], width)
    out: list[tuple[int, int, int]] = []
    if len(vectors) and len(queries):
        exact = float(np.abs(vectors).max()) * float(np.abs(queries).max()) * width < 2**53
        kind = np.float64 if exact else np.int64
        vectors, queries = vectors.astype(kind), queries.astype(kind)
        lengths = np.sqrt(has["size"].to_numpy())
        unit = vectors / np.where(lengths > 0, lengths, 1)[:, None]
        order = np.argsort(unit, axis=0, kind="stable").T
        for q, query_id, size, wanted in zip(queries, asks["vec_id"], asks["size"], asks["wanted"]):
            place = candidates_of(q.astype(np.float64), float(np.sqrt(size)), wanted, vectors, lengths, unit, order)
            found, scores = ids[place], (vectors[place] @ q).astype(np.int64)
            other = (found != query_id) & (scores >= wanted)
            found, scores = found[other], scores[other]
            out += [(query_id, found[i], scores[i]) for i in best(scores, found, k)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products of floor(scale * component).

    Queries are the rows whose vec_id is divisible by `every`; candidates are all rows of as many components but those
    of the query's own vec_id. Ties go to the smaller vec_id, fewer candidates are all given, repeated rows count once.
    Rows without vec_id or vector, or with a null or non-finite component, take no part; other columns neither.
    """
    whole = F.transform("vector", lambda x: F.floor(x * scale).cast("double"))
    rows = usable(vectors, may_be_zero=True).select("vec_id", whole.alias("vector"))
    length = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)
    rows = rows.withColumns({"size": length, "width": F.size("vector"), "one": F.lit(1)})
    ranked = written(running_totals(rows, ["width", F.col("size").desc(), "vec_id"], "one", "rank").drop("one"))
    # buckets and blocks of one width: its first row begins a bucket
    widths = ranked.groupBy("width").agg(F.min("rank").alias("first"))
    ranked = ranked.join(F.broadcast(widths), "width").withColumn("bucket", F.floor((F.col("rank") - F.col("first")) / BUCKET).cast("int"))
    buckets = ranked.groupBy("width", "bucket").agg(F.max("size").alias("longest"))
    asks = ranked.where(F.col("vec_id") % every == 0)
    blocks = F.greatest(F.ceil(asks.count() / F.lit(BLOCK)), F.lit(1)).cast("int")
    asks = asks.select("vec_id", "vector", "size", "width", F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias("block"))
    has = ranked.select("vec_id", "vector", "size", "width", "bucket", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(None).cast("double").alias("wanted"))

    def search(asked: DataFrame, among: DataFrame) -> DataFrame:
        both = among.unionByName(asked.select(among.columns))
        return both.groupBy("width", "bucket", "block").applyInPandas(lambda g: search_block(g, k), "query_id long, vec_id long, score long")

    first = asks.withColumns({"bucket": F.lit(0), "wanted": F.lit(float("-inf"))})
    start = written(search(first, has.where("bucket = 0")))
    reached = start.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    wanted = F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(float("-inf"))
    further = asks.join(reached, asks["vec_id"] == reached["query_id"], "left").withColumn("wanted", F.coalesce(wanted, F.lit(float("-inf"))))
    further = further.join(buckets.where("bucket > 0"), "width")  # a query and a bucket, for those it may be in:
    further = further.where(F.sqrt("size") * F.sqrt("longest") * (1 + SLACK) >= F.col("wanted"))
    return merged(start.unionByName(search(further, has.where("bucket > 0"))), k)
