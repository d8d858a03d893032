"""Quality of documents: plain rules, then how much likelier their n-grams are in trusted documents than in all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed, written
from .spans import IN_LINE, IN_WORD, LEADS, Texts, byte_table, named, runs, slices, sums, texts_of

#: n-grams are three characters; their hash is the polynomial of their code points.
BASE, BUCKETS = 1_000_003, 65_521
#: A document is kept if the mean of its n-grams' gains, in millionths of a natural logarithm, is so much or more.
LEAST_MEAN = -50_000
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
#: Up to so many ids of trusted documents go to every task (8 bytes each); more are joined by a shuffle.
MOST_SENT = 2_000_000

SYMBOL = byte_table(lambda b: b in b"#*$%&|<>")


def ngram_buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the trigrams of all texts, and where each text's begin."""
    characters = np.frombuffer(texts.data.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
    lengths = texts.totals(LEADS[texts.data])
    many = np.maximum(lengths - 2, 0)
    offsets = np.append(0, np.cumsum(many))
    starts = np.cumsum(lengths) - lengths
    places = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], many)
    return (characters[places] * BASE**2 + characters[places + 1] * BASE + characters[places + 2]) % BUCKETS, offsets


def repeated_words(words: np.ndarray, text: np.ndarray, many: int) -> np.ndarray:
    """For each of many texts, its words in windows of WINDOW words that it has twice or more. words: numbers; text: each word's."""
    windows = max(0, len(words) - WINDOW + 1)
    starts = np.flatnonzero(text[:windows] == text[len(text) - windows :])  # windows within one text
    if not len(starts):
        return np.zeros(many, np.int64)
    names, base = text[starts], int(words.max()) + 1
    for k in range(WINDOW):  # a window's name: that of its text and first words, with the next word
        names, _ = named(names * base + words[starts + k])
    again = starts[np.bincount(names)[names] > 1]
    edges = np.zeros(len(words) + 1, np.int64)
    edges[again] += 1
    edges[again + WINDOW] -= 1
    return np.bincount(text[np.cumsum(edges[:-1]) > 0], minlength=many)


def repeated_lines(texts: Texts, inside: np.ndarray) -> np.ndarray:
    """For each text, its lines with a word that equal an earlier one. inside: whether a byte is of a word."""
    lines, total = runs(texts, IN_LINE), np.append(0, np.cumsum(inside))
    filled = total[lines.starts + lines.lengths] > total[lines.starts]
    numbers, distinct = named(lines.bytes)
    text = lines.text[filled]
    kinds = np.unique(text * max(1, len(distinct)) + numbers[filled])
    return np.bincount(text, minlength=len(texts)) - np.bincount(kinds // max(1, len(distinct)), minlength=len(texts))


def measures(texts: Texts) -> dict[str, np.ndarray]:
    inside, words = IN_WORD[texts.data], runs(texts, IN_WORD)
    return {
        "n_words": words.counts,
        "word_chars": texts.totals(inside & LEADS[texts.data]),
        "n_symbols": texts.totals(SYMBOL[texts.data]),
        "n_dup_lines": repeated_lines(texts, inside),
        "n_repeat_words": repeated_words(named(words.bytes)[0], words.text, len(texts)),
    }


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents that labels call good, and never bad."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most")).where("least = 1 and most = 1").select("doc_id")


def with_trust(docs: DataFrame, labels: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """doc_id, text of docs, and trusted: whether labels call it good."""
    ids = written(trusted_ids(labels).select(F.col("doc_id").alias("good")))
    few = F.broadcast(ids) if ids.count() <= most_sent else ids
    docs = docs.select("doc_id", "text")
    return docs.join(few, F.col("doc_id") == F.col("good"), "left").select("text", F.col("good").isNotNull().alias("trusted"))


def ngram_counts(docs: DataFrame) -> DataFrame:
    """bucket, raw, target of text, trusted: n-grams of all rows and of trusted ones; a task sends at most a row for each bucket."""

    def scan(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                buckets, offsets = ngram_buckets(texts_of(piece.column("text")))
                good = np.repeat(piece.column("trusted").to_numpy(zero_copy_only=False), np.diff(offsets))
                total[0] += np.bincount(buckets, minlength=BUCKETS)
                total[1] += np.bincount(buckets[good], minlength=BUCKETS)
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (seen, total[0][seen], total[1][seen])], names=["bucket", "raw", "target"])

    found = docs.mapInArrow(trimmed(scan), "bucket long, raw long, target long")
    return found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ngram_gains(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Of each bucket, millionths of the logarithm of how much likelier trusted documents have it, one added to each count; zeros if none is trusted."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in ngram_counts(with_trust(docs, labels)).collect():  # BUCKETS rows at most
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.any():
        return np.zeros(BUCKETS, np.int64)
    ratio = (target + 1) * (raw.sum() + BUCKETS) / ((raw + 1) * (target.sum() + BUCKETS))
    return np.floor(1_000_000 * np.log(ratio)).astype(np.int64)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams", "gain")


def judged(docs: DataFrame, labels: DataFrame, least_mean: int = LEAST_MEAN) -> DataFrame:
    """For every row of docs (doc_id, text) its doc_id, measures, n_grams, gain (their sum), base_failed and kept.

    labels: doc_id, quality (1: trusted). Base rules fail fewer than LEAST_WORDS words, and more than MOST_REPEATED of a hundred words in repeated windows.
    Of the others those are kept whose gain is `least_mean` or more an n-gram. All documents are counted, and all that
    labels trust. Null and empty texts have no words and fail; texts are read whole, however long; repeated rows each count and
    stay; rows without doc_id are trusted by no label; without trusted documents all gains are 0 and the base rules
    decide; an empty table gives an empty one; other columns play no part.
    """
    gains = ngram_gains(docs, labels)

    def scan(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                texts = texts_of(piece.column("text"))
                buckets, offsets = ngram_buckets(texts)
                found = measures(texts) | {"n_grams": np.diff(offsets), "gain": sums(gains[buckets], offsets)}
                columns = [piece.column("doc_id").cast(pa.int64()), *(pa.array(found[k], pa.int64()) for k in FIELDS)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *FIELDS])

    found = docs.select("doc_id", "text").mapInArrow(trimmed(scan), "doc_id long, " + ", ".join(f"{k} long" for k in FIELDS))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("gain") >= least_mean * F.col("n_grams")))
