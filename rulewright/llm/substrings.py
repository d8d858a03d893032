"""Substring dedup: words that a window shared with another place covers are removed, found by recompression.

1. Each task recompresses its documents (see recompress). Every window of `width` words is stood for by one symbol
   inside it; consecutive windows with one occurrence of a symbol are a chunk, about a tenth as many as windows.
2. Chunks are counted by symbol and by content. A symbol that occurs once shows that its windows are unique. A chunk
   whose content occurs again is all repeated. What remains are chunks of shared symbols that differ as a whole,
   at the ends of repeats.
3. Only there, the windows themselves are counted, beside those of one chunk of each shared content.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, trimmed, written
from .recompress import U, levels, mix, representatives, span_hashes
from .tokens import forget

ROUNDS = 2
#: Words from a symbol's first on that are compared as its own; they are part of each window it stands for.
REACH = 8
#: Documents that a task holds unpacked at once.
SLICE = 256
#: Words that are recompressed at once, at least a document; words whose hashes a task keeps.
BATCH_WORDS, KEPT_WORDS = 60_000, 100_000
COVERED, COMPARED, BOTH = 1, 2, 3


class WordHashes:
    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > KEPT_WORDS:
                self.known = {}
            for word in words:
                if word not in self.known:
                    self.known[word] = xxh64_intdigest(word)
            found = list(map(self.known.get, words))
        return np.array(found, U)


def chunks(docs: DataFrame, width: int) -> DataFrame:
    """k1, k2 (the document), first (its first window), count (its windows), symbol, content (a hash of its words)."""

    reach = min(REACH, width)

    def cut(batches):
        forget()
        known = WordHashes()

        def made(keys, words):
            sizes = np.array(list(map(len, words)), np.int64)
            hashes = known.of([w for x in words for w in x])
            ends = np.cumsum(sizes)
            closes = np.zeros(len(hashes), bool)
            closes[ends - 1] = True
            windows = sizes - width + 1
            document = np.repeat(np.arange(len(words)), windows)
            starts = np.arange(windows.sum()) + np.repeat(ends - sizes - np.cumsum(windows) + windows, windows)
            name, place = representatives(levels(hashes, closes, ROUNDS), starts, width, reach)
            # symbols of several levels can begin at one word
            new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (name[1:] != name[:-1]) | (document[1:] != document[:-1])))
            count = np.diff(np.append(new, len(starts)))
            first = starts[new]
            symbol = name[new]
            shape = ((place[new] - first) << 32 | count).astype(U)
            content = mix(span_hashes(hashes, first, first + count + width - 1), mix(symbol, shape, 5), 9)
            at = document[new]
            columns = [*(np.array(k, np.int64)[at] for k in zip(*keys)), (first - (ends - sizes)[at]).astype(np.int32), count.astype(np.int32), symbol.view(np.int64), content.view(np.int64)]
            return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["k1", "k2", "first", "count", "symbol", "content"])

        for batch in batches:
            keys, words, size = [], [], 0
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                split = text.as_buffer().to_pybytes().split() if text.is_valid else []
                if len(split) >= width:
                    keys.append((k1, k2))
                    words.append(split)
                    size += len(split)
                if size >= BATCH_WORDS:
                    yield made(keys, words)
                    keys, words, size = [], [], 0
            if keys:
                yield made(keys, words)

    return docs.select("k1", "k2", "text").mapInArrow(trimmed(cut), "k1 long, k2 long, first int, count int, symbol long, content long")


def covered(n: int, starts, counts, width: int) -> np.ndarray:
    """Of n words, those that the given windows (runs of `count` from `start`) cover."""
    steps, starts, counts = np.zeros(n + 1, np.int64), np.array(starts, np.int64), np.array(counts, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + counts + width - 1, -1)
    return np.cumsum(steps)[:-1] > 0


def kept(words: list[bytes], gone: np.ndarray, digest: bool, unchanged: bool) -> str | None:
    if not unchanged and not gone.any():
        return None
    text = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
    return hashlib.sha256(text).hexdigest() if digest else text.decode()


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(-1)).alias("k1"), text_hash(F.col("text")).alias("k2"), "doc_id", "text")


def text_hash(text: Column) -> Column:
    """All 64 bits: where many rows have one doc_id, this alone tells them apart."""
    return F.xxhash64(text)


def packed(docs: DataFrame) -> DataFrame:
    """keyed docs with their texts compressed, for the way through a shuffle."""

    def pack(batches):
        from zstandard import ZstdCompressor

        zip_ = ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                blobs = [zip_.compress(t.as_buffer()) if t.is_valid else None for t in part.column(3)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(blobs, pa.binary())], names=["k1", "k2", "doc_id", "packed"])

    return docs.mapInArrow(trimmed(pack), "k1 long, k2 long, doc_id long, packed binary")


def words_of(blob: pa.Scalar) -> list[bytes]:
    from zstandard import ZstdDecompressor

    return ZstdDecompressor().decompress(blob.as_buffer()).split() if blob.is_valid else []


def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Of an array<long> column: where each row's items begin and end, and all items."""
    ends = column.offsets.to_numpy()
    sizes = np.diff(ends)
    if column.null_count:
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    return np.stack([ends[:-1], ends[:-1] + sizes], 1), column.values.to_numpy(zero_copy_only=False)


def without_repeats(docs: DataFrame, width: int = 35, digest: bool = False, unchanged: bool = True) -> DataFrame:
    """doc_id, k1, k2, n_words, n_removed and kept of every row of docs.

    kept: the words left, joined by a space, or with digest the sha256 of that, in hexadecimal; where nothing is removed and
    unchanged is false, null. A word goes if it is in a window
    of `width` consecutive words that starts anywhere else too, here or in another row, before anything is removed.
    Null texts are without words; shorter texts than a window keep all. Repeated rows are repeats of
    one another. Null doc_ids are kept. k1 and k2 (doc_id, hash of the text) name the row, for joins.
    """
    all_parts = written(chunks(keyed(docs), width))
    # first document: gives the windows of its chunk for comparison
    parts = all_parts.where("symbol is not null and content is not null")
    known = parts.groupBy("symbol", "content").agg(F.count("*").alias("times"), F.min("k1").alias("giver"))
    # with all columns of known in use here too, Spark shuffles and counts once for both
    shared = known.groupBy("symbol").agg(F.count("*").alias("contents"), F.sum((F.col("times") == 1).cast("int")).alias("single"), F.max("giver").alias("any"))
    shared = shared.where("contents > 1 and single > 0 and any is not null").select(F.col("symbol").alias("of"), F.lit(True).alias("differs"))
    status = known.join(shared, F.col("symbol") == F.col("of"), "left").where("times > 1 or differs")
    check = F.coalesce(F.col("symbol").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"), F.lit(0))  # beside the content's 64 bits, 31 of its symbol's
    status = status.select(check.alias("s"), F.col("content").alias("c"), "times", "giver", "differs")
    kind = F.when(F.col("times") == 1, COMPARED).when(F.col("differs") & (F.col("k1") == F.col("giver")), BOTH).otherwise(COVERED)
    mark = F.shiftleft(F.col("first").cast("long"), 32) + F.shiftleft(F.col("count").cast("long"), 2) + kind
    claims = parts.select("k1", "k2", "first", "count", "content", check.alias("check"))
    marked = claims.join(status, (F.col("content") == F.col("c")) & (F.col("check") == F.col("s"))).select("k1", "k2", mark.alias("mark"))
    marks = marked.groupBy(F.col("k1").alias("m1"), F.col("k2").alias("m2")).agg(F.collect_set("mark").alias("marks"))
    marks = written(marks)
    discard(all_parts)

    def first_pass(batches):
        known = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                yield first_slice(batch.slice(at, SLICE), known)

    def first_slice(part, known):
        spans, marks = lists(part.column("marks"))
        first, count, kind = marks >> 32, marks >> 2 & (1 << 30) - 1, marks & 3
        rows, texts, covering, sizes, hashes, places = [], [], [], [], [], []
        for (a, b), blob in zip(spans.tolist(), part.column("packed")):
            words, starts, counts = words_of(blob), first[a:b], count[a:b]
            own, given = kind[a:b] != COMPARED, kind[a:b] != COVERED
            gone = covered(len(words), starts[own], counts[own], width)
            n, mine = counts[given], np.repeat(kind[a:b][given] == COMPARED, counts[given])
            at = np.arange(n.sum()) + np.repeat(starts[given] - np.cumsum(n) + n, n)
            sizes.append(len(at))
            if len(at):
                hashes.append(span_hashes(known.of(words), at, at + width).view(np.int64))
                places.append(np.where(mine, at, -1))
            done = not mine.any()
            rows.append((len(words), int(gone.sum()), kept(words, gone, digest, unchanged) if done else None))
            texts.append(None if done else blob.as_py())
            covering.append(None if done else np.stack([starts[own], counts[own]], 1).ravel())
        windows = pa.StructArray.from_arrays([pa.array(np.concatenate([*x, np.zeros(0, t)]).astype(t)) for x, t in ((hashes, np.int64), (places, np.int32))], names=["hash", "at"])
        windows = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), windows)
        n, lost, left = zip(*rows)
        columns = [pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(left, pa.string()), pa.array(texts, pa.binary()), pa.array(covering, pa.list_(pa.int32())), windows]
        return pa.RecordBatch.from_arrays([*(part.column(k) for k in ("doc_id", "k1", "k2")), *columns], names=list("abcdefghi"))

    joined = packed(keyed(docs)).join(marks, (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")), "left").select("doc_id", "k1", "k2", "packed", "marks")
    row = "doc_id long, k1 long, k2 long, n_words long, n_removed long, kept string"
    first = written(joined.mapInArrow(trimmed(first_pass), f"{row}, packed binary, spans array<int>, windows array<struct<hash: long, at: int>>"))

    windows = first.select("k1", "k2", F.explode("windows").alias("w")).select("k1", "k2", "w.hash", "w.at")
    again = windows.groupBy(F.col("hash").alias("h")).count().where("count > 1")
    found = windows.where("at >= 0").join(again, F.col("hash") == F.col("h"), "left_semi")
    found = found.groupBy(F.col("k1").alias("m1"), F.col("k2").alias("m2")).agg(F.collect_list("at").alias("found"))

    def second_pass(batches):
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part, rows = batch.slice(at, SLICE), []
                for blob, spans, at in zip(part.column("packed"), part.column("spans").to_pylist(), part.column("found").to_pylist()):
                    words, at = words_of(blob), at or []
                    gone = covered(len(words), spans[::2] + at, spans[1::2] + [1] * len(at), width)
                    rows.append((len(words), int(gone.sum()), kept(words, gone, digest, unchanged)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("doc_id", "k1", "k2")), *columns], names=list("abcdef"))

    rest = first.where("packed is not null").join(found, (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")), "left")
    rest = rest.select("doc_id", "k1", "k2", "packed", "spans", "found").mapInArrow(trimmed(second_pass), row)
    return first.where("packed is null").select(rest.columns).unionByName(rest)


def cleaned_documents(docs: DataFrame, width: int = 35) -> DataFrame:
    """docs with only the words kept in `text`; null texts stay null, and rows that keep all their words stay as they were."""
    kept_ = written(without_repeats(docs, width, unchanged=False).where("n_removed > 0").select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.col("kept").alias(text := fresh(docs, "kept"))).distinct())
    on = (F.coalesce(docs["doc_id"], F.lit(-1)) == F.col("r1")) & (text_hash(docs["text"]) == F.col("r2"))
    return docs.join(kept_, on, "left").withColumn("text", F.coalesce(text, docs["text"])).select(*docs.columns)
