"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors are scaled to at most length 1 and given one more component that makes it 1; for queries that is 0. The
nearest of these points to a query's is then the one of the largest product. A table's hash is a bucket number
for each of several random projections (Gaussian, which is stable for Euclidean distance). A query visits its own bucket and those next to
it, in the order of the squared distances to the sides it crosses, an estimate of where neighbours are likely (Lv and others,
2007). How many it visits is fitted on a bounded sample to a recall against brute force.

All tables' rows, sorted by bucket, are cut into cells of CELL rows, so that a large bucket is several cells.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import running_totals, written
from .vectors import best, merged, stacked, usable

TABLES, HASHES, SEED = 2, 5, 17
#: Rows and queries of the sample that the number of probes is fitted on, and the recall it is fitted to.
SAMPLE, SAMPLE_QUERIES, RECALL = 4000, 200, 0.96
CELL, BLOCK = 16384, 2048
#: Bucket numbers of one table as one long: each is between -HALF and HALF, farther ones count as that.
HALF = 2048


class Index:
    """The projections of all tables; `probes` is set by fit()."""

    def __init__(self, width: int, longest: float, side: float):
        rng = np.random.default_rng(SEED)
        self.width, self.longest, self.side = width, longest, side
        self.lines = rng.normal(0, 1, (TABLES, width + 1, HASHES))
        self.shift = rng.uniform(0, 1, (TABLES, HASHES))
        self.moves = np.array(list(product((0, -1, 1), repeat=HASHES)), np.int64)
        self.probes = len(self.moves)

    def points(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        length = np.sqrt((vectors**2).sum(1))
        x = vectors / (length[:, None] if query else self.longest)
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, 1 - (x**2).sum(1)))
        return np.concatenate([x, rest[:, None]], 1)

    def codes(self, cells: np.ndarray) -> np.ndarray:
        """(n, TABLES, ...): one number for a bucket's numbers and its table."""
        cells = np.clip(cells, -HALF, HALF - 1) + HALF
        table = np.arange(TABLES).reshape(TABLES, *[1] * (cells.ndim - 3))
        return (cells @ (2 * HALF) ** np.arange(HASHES, dtype=np.int64)) * TABLES + table

    def own(self, vectors: np.ndarray) -> np.ndarray:
        """(n, TABLES): the bucket of each candidate."""
        at = np.einsum("nd,tdh->nth", self.points(vectors, False), self.lines) / self.side + self.shift
        return self.codes(np.floor(at).astype(np.int64))

    def visits(self, vectors: np.ndarray) -> np.ndarray:
        """(n, TABLES, probes): the buckets each query visits, likeliest first."""
        at = np.einsum("nd,tdh->nth", self.points(vectors, True), self.lines) / self.side + self.shift
        cell = np.floor(at).astype(np.int64)
        inside = at - cell
        cost = np.stack([np.zeros_like(inside), inside**2, (1 - inside) ** 2], -1)  # to stay, go down, go up
        chosen = np.stack([self.moves == m for m in (0, -1, 1)], -1).reshape(len(self.moves), -1).astype(np.float64)
        total = cost.reshape(*cost.shape[:2], -1) @ chosen.T
        order = np.argsort(total, axis=2, kind="stable")[:, :, : self.probes]
        return self.codes(cell[:, :, None] + self.moves[order])

    def fit(self, sample: np.ndarray, k: int) -> bool:
        """Takes the least number of probes with the wanted recall; False if even all of them haven't."""
        queries = sample[:: max(1, len(sample) // SAMPLE_QUERIES)]
        near = np.argsort(-(queries @ sample.T), axis=1)[:, : k + 1]
        own = self.own(sample)[near]  # (queries, k, TABLES)
        visits = self.visits(queries)
        first = (own[..., None] == visits[:, None]).argmax(-1)  # which probe finds it in a table
        missed = ~(own[..., None] == visits[:, None]).any(-1)
        first = np.where(missed, len(self.moves), first).min(-1)
        found = np.sort(first, axis=None)
        at = int(np.ceil(RECALL * found.size)) - 1
        if found[at] >= len(self.moves):
            return False
        self.probes = int(found[at]) + 1
        return True


def build(rows: DataFrame, width: int, k: int) -> Index:
    """An index fitted to at most SAMPLE of rows, those of the least hash of vec_id; buckets widen until it can reach RECALL."""
    longest = rows.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)))).first()[0]
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    sample, side = stacked(taken["vector"], width), 1.0
    while not (index := Index(width, longest, side)).fit(sample, k):
        side *= 1.25
    return index


def search_cell(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """A block of queries in one cell: products with the rows of the buckets that each visits there."""
    has, asks = rows[rows["codes"].isna()].sort_values(["code", "vec_id"]), rows[rows["codes"].notna()]
    out = []
    if len(has) and len(asks):
        vectors, ids, codes = np.stack(has["vector"].to_numpy()), has["vec_id"].to_numpy(), has["code"].to_numpy()
        for q, query_id, visited in zip(asks["vector"], asks["vec_id"], asks["codes"]):
            visited = np.asarray(visited) if len(visited) else np.unique(codes)  # none: all
            a, b = np.searchsorted(codes, visited), np.searchsorted(codes, visited, side="right")
            n = b - a
            place = np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)
            place = place[np.unique(ids[place], return_index=True)[1]] if TABLES > 1 else place  # a row is in each table
            place = place[ids[place] != query_id]
            scores = vectors[place] @ np.asarray(q)
            out += [(query_id, ids[place[i]], scores[i]) for i in best(scores, ids[place], k)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: of each query, the k nearest rows found, by largest inner product of the vectors as given.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all rows of as many components but those
    of the query's own vec_id, and all of them are in the index. Ties go to the smaller vec_id. Where a query's buckets
    hold fewer than k rows though there are more, all rows are searched for it. Repeated rows count once. Rows without
    vec_id or vector, of length zero, or with a null or non-finite component take no part; other columns neither.
    """
    rows = written(usable(vectors, may_be_zero=False))
    found = [_nearest(rows.where(F.size("vector") == w), w, every, k) for (w,) in sorted(rows.select(F.size("vector")).distinct().collect())]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _nearest(rows: DataFrame, width: int, every: int, k: int) -> DataFrame:
    index = build(rows, width, k)
    kept = T.StructType([*rows.schema.fields, T.StructField("code", T.LongType())])

    def hashed(frames):
        for f in frames:
            codes = index.own(stacked(f["vector"], width))
            yield pd.concat([f.assign(code=codes[:, t]) for t in range(TABLES)])

    def visiting(frames):
        for f in frames:
            for at in range(0, len(f), 256):
                part = f.iloc[at : at + 256]
                visits = index.visits(stacked(part["vector"], width))
                yield pd.DataFrame({"query": np.repeat(part["vec_id"].to_numpy(), visits[0].size), "code": visits.ravel()})

    entries = running_totals(rows.mapInPandas(hashed, kept).withColumn("one", F.lit(1)), ["code", "vec_id"], "one", "rank")
    entries = written(entries.withColumn("cell", F.floor(F.col("rank") / CELL)).drop("one", "rank"))
    asks = rows.where(F.col("vec_id") % every == 0)
    queries = asks.count()
    blocks = max(1, -(-queries // BLOCK))
    leaves = entries.select("code", "cell").distinct()
    sent = asks.mapInPandas(visiting, "query long, code long").join(leaves, "code")
    sent = sent.groupBy("query", "cell").agg(F.collect_set("code").alias("codes"))
    sent = sent.join(asks, F.col("query") == F.col("vec_id")).select(
        "cell", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "vector", F.lit(None).cast("long").alias("code"), "codes"
    )
    has = entries.select("cell", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "vector", "code", F.lit(None).cast("array<long>").alias("codes"))
    schema = "query_id long, vec_id long, score double"
    found = written(has.unionByName(sent).groupBy("cell", "block").applyInPandas(lambda g: search_cell(g, k), schema))
    # queries with too few rows in their buckets: every row, in cells
    counts = found.select("query_id", "vec_id").distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    possible = rows.select("vec_id").distinct().count() - 1
    short = asks.join(counts, F.col("vec_id") == F.col("query_id"), "left").where(F.coalesce("n", F.lit(0)) < min(k, possible)).select("vec_id", "vector")
    cells = entries.agg(F.max("cell")).first()[0] or 0
    rest = short.select(
        F.explode(F.sequence(F.lit(0), F.lit(cells)).cast("array<long>")).alias("cell"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "vector", F.lit(None).cast("long").alias("code"), F.array().cast("array<long>").alias("codes")
    )
    more = has.unionByName(rest).groupBy("cell", "block").applyInPandas(lambda g: search_cell(g, k), schema)
    return merged(found.unionByName(more), k)
