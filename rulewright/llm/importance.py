"""Resampling documents by importance: those most like a target, by hashed n-grams, with Gumbel noise.

Words become numbers of a dictionary, n-grams tuples of these, and only distinct tuples are written out as bytes and
hashed; their buckets go back to all places by the tuples' numbers. A dictionary is that of a few megabytes of
documents: one of the whole corpus would need a shuffle of nearly as many tuples as it has words, to save hashes only.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_totals, trimmed, written
from .spans import Texts, byte_table, named, runs, slices, texts_of

BUCKETS = 10_000
LONGEST = 3
#: Documents with fewer words are never drawn; of the others, so many in a hundred are.
LEAST_WORDS, PERCENT = 20, 5
SEED = 42

#: Digits, small ASCII letters and all of a character beyond ASCII.
IN_FEATURE = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def hashed(grams: pa.Array) -> np.ndarray:
    _, offsets, data = grams.buffers()
    offsets, data = np.frombuffer(offsets, np.int64)[grams.offset : grams.offset + len(grams) + 1].tolist(), data.to_pybytes() if data else b""
    # slices of one bytes object, as Arrow's own values take many times longer to make
    return np.fromiter(map(zlib.crc32, map(data.__getitem__, map(slice, offsets, offsets[1:]))), np.int64, len(grams)) % BUCKETS


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text; and of each of its runs of 1 to LONGEST words the text's place and the bucket."""
    words = runs(Texts(LOWER[texts.data], texts.offsets), IN_FEATURE)
    text, (ids, dictionary) = words.text, named(words.bytes)
    tuples, grams = ids, dictionary
    places, buckets = [text], [hashed(dictionary)[ids]]
    for n in range(2, LONGEST + 1):
        if len(ids) < n:
            break
        whole = text[n - 1 :] == text[: len(text) - n + 1]
        # a tuple of n is the number of its first n - 1 words' tuple and the number of its last word
        pairs = (tuples[: len(ids) - n + 1] * len(dictionary) + ids[n - 1 :])[whole]
        numbers, distinct = named(pairs)
        first, last = np.divmod(distinct.to_numpy(zero_copy_only=False), len(dictionary))
        grams = pc.binary_join_element_wise(grams.take(pa.array(first)), dictionary.take(pa.array(last)), pa.scalar(b" ", pa.large_binary()))
        places.append(text[: len(whole)][whole])
        buckets.append(hashed(grams)[numbers])
        tuples = np.zeros(len(whole), np.int64)
        tuples[whole] = numbers
    return words.counts, np.concatenate(places), np.concatenate(buckets)


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features and gaps for each row of docs: its features' buckets in order, each as what it is above the last."""

    def scan(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                counts, places, buckets = features(texts_of(piece.column("text")))
                keys = np.sort(places * BUCKETS + buckets)
                n = np.bincount(places, minlength=piece.num_rows)
                ends = np.cumsum(n)
                values = keys % BUCKETS
                gaps = np.diff(values, prepend=0)
                firsts = (ends - n)[n > 0]
                gaps[firsts] = values[firsts]
                made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(0, 2 * ends).astype(np.int64)), pa.py_buffer(gaps.astype("<u2"))])
                columns = [piece.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(n, pa.int64()), made.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "gaps"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(scan), "doc_id long, n_words long, n_features long, gaps binary")


def decoded(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a piece of what encoded() gives, and where each row's begin."""
    texts = texts_of(piece.column("gaps"))
    offsets = texts.offsets // 2
    total = np.append(0, np.cumsum(texts.data.view("<u2"), dtype=np.int64))
    return total[1:] - np.repeat(total[offsets[:-1]], np.diff(offsets)), offsets


def bucket_counts(rows: DataFrame) -> DataFrame:
    """bucket, n: features of all rows; each task sends at most a row for each bucket."""

    def scan(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for piece in slices(batch, "gaps"):
                total += np.bincount(decoded(piece)[0], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    return rows.select("gaps").mapInArrow(trimmed(scan), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's thousandths of the logarithm of how much likelier the target has it, one added to each count."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def counts_array(rows: DataFrame) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for r in bucket_counts(rows).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) for every row of docs (doc_id, text), by likeness to target (text).

    Of the rows with `least_words` words or more, those with the highest scores are drawn, `percent` in a hundred of them,
    rounded down; ties go to the smaller doc_id, no doc_id last, then to fewer features. A score is the weight and Gumbel noise that
    seed and doc_id alone decide ('null' for none), so that reruns agree. Null and empty texts have no features and weight 0;
    texts are whole, however long; repeated rows count each for itself and get ranks of their own; without documents there is
    no row, without a target all its counts are 0; other columns play no part.
    """
    folded = written(encoded(docs))
    weights = gains(counts_array(folded), counts_array(encoded(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))))

    def scan(batches):
        for batch in batches:
            for piece in slices(batch, "gaps"):
                buckets, offsets = decoded(piece)
                total = np.append(0, np.cumsum(weights[buckets]))
                weight = pa.array(total[offsets[1:]] - total[offsets[:-1]], pa.int64())
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], weight], names=["doc_id", "n_words", "n_features", "weight"])

    weighed = folded.mapInArrow(trimmed(scan), "doc_id long, n_words long, n_features long, weight long")
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296
    noise = F.floor(-1000 * F.log(-F.log(uniform))).cast("long")
    able = (F.col("n_words") >= least_words).cast("int")
    rows = written(weighed.select("*", (F.col("weight") + noise).alias("score"), able.alias("able")))
    # equal rows are told apart by their place, so that even they are dealt over many tasks
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    most = rows.agg(F.coalesce(F.sum("able"), F.lit(0))).first()[0] * percent // 100
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "place"]
    drawn = (F.col("able") == 1) & (F.col("before") < most)
    rank = F.when(drawn, F.col("before") + 1)
    return running_totals(rows, order, "able").select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
