"""Best-fit packing of token pieces into sequences, by exact complements.

Which lengths share a sequence depends on how many pieces have each length only: a table of at most `capacity`
rows, whatever the corpus. From it the driver makes templates (lengths that share a sequence, and how many
sequences look so). Pieces are then dealt to templates by their rank among those of their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, running_totals, trimmed, written
from .tokens import SLICE, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, with_ids: bool = False, lean: bool = False) -> DataFrame:
    """doc_id, piece (from 0), start (ids of the document before it), length, ids_crc32 and, if asked for, ids.

    A text's ids (null: none) and end_id are one piece, or several of `capacity` ids if they are more; the last
    may be shorter. So an empty text is a piece of one id. Null and repeated doc_ids are kept as they are.
    """
    ids_type = pa.list_(pa.int64())

    def cut(batches):
        codes = encoder(tokenizer_path, lean)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, len(b), SLICE)):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), codes.encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    piece = ids[at : at + capacity]
                    rows.append((doc_id, k, at, len(piece), zlib.crc32(piece.tobytes()), *([piece.tolist()] if with_ids else [])))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), ids_type]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(rows[0])])

    return docs.select("doc_id", "text").mapInArrow(trimmed(cut), PIECES + ", ids array<long>" * with_ids)


class Stock:
    """How many pieces of each length are left, and what lengths two of them add up to."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.copy()
        self.sums: np.ndarray | None = None

    def index_pairs(self) -> None:
        """sums[s]: some two lengths in stock add up to s. Stock only shrinks, so that an old index errs on the safe side."""
        have = int.from_bytes(np.packbits(self.left > 0, bitorder="little").tobytes(), "little")
        both = 0
        for length in np.flatnonzero(self.left):
            both |= have << int(length)
        size = len(self.left)
        both &= (1 << size) - 1
        self.sums = np.unpackbits(np.frombuffer(both.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little")[:size] > 0

    def single(self, gap: int) -> tuple[int, ...]:
        return (gap,) if self.left[gap] > 0 else ()

    def pair(self, gap: int) -> tuple[int, ...]:
        """The pair with the longest larger part."""
        small = np.arange(1, gap // 2 + 1)
        good = np.flatnonzero((self.left[small] > 0) & (self.left[gap - small] > (small * 2 == gap)))
        return (gap - int(small[good[0]]), int(small[good[0]])) if len(good) else ()

    def triple(self, gap: int) -> tuple[int, ...]:
        """The triple with the longest part for which the index of pair sums has the rest."""
        for length in np.flatnonzero((self.left[:gap] > 0) & self.sums[gap:0:-1])[::-1]:
            length = int(length)
            self.left[length] -= 1
            rest = self.pair(gap - length)
            self.left[length] += 1
            if rest:
                return (length, *rest)
        return ()


def templates(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Lengths that share a sequence, with how many sequences do so; counts[l] is the number of pieces of length l.

    A sequence begins with the longest piece left. Its gap is filled exactly by one, two or three lengths in stock
    if any are; else the longest piece that fits goes in (best fit) and the smaller gap is tried. The same
    template is then used as often as the stock allows.
    """
    capacity = len(counts) - 1
    stock, out, since = Stock(counts.astype(np.int64)), [], 0
    stock.index_pairs()
    top = capacity
    while True:
        while top and not stock.left[top]:
            top -= 1
        if not top:
            return out
        if since >= 256:
            stock.index_pairs()
            since = 0
        since += 1
        lengths, gap = [top], capacity - top
        stock.left[top] -= 1
        while gap:
            found = stock.single(gap) or stock.pair(gap) or stock.triple(gap)
            if not found:
                fitting = np.flatnonzero(stock.left[: gap + 1])
                if not len(fitting):
                    break
                found = (int(fitting[-1]),)
            for length in found:
                stock.left[length] -= 1
            lengths += found
            gap -= sum(found)
        kinds, each = np.unique(lengths, return_counts=True)
        more = int((stock.left[kinds] // each).min())
        stock.left[kinds] -= more * each
        out.append((lengths, more + 1))


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces (with `length`, from 1 to capacity) with sequence_id and offset: few sequences, filled from 0 without gaps.

    Pieces of one length are dealt in the order of their other columns; equal rows are dealt one by one. An empty
    table gives an empty one. `pieces` is read twice: give a written table.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, count in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of length {length} in sequences of {capacity}")
        counts[length] = count
    # spans: runs of pieces of one length that go to the same place of consecutive sequences
    spans, used, sequence = [], np.cumsum(counts) - counts, 0
    for lengths, times in templates(counts):
        offset = 0
        for length in lengths:
            spans.append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    first, base, offsets = (np.array(x, np.int64) for x in (zip(*sorted(spans)) if spans else ([], [], [])))

    simple = [c for c, t in pieces.dtypes if c not in ("length", "one") and not t.startswith(("array", "map", "struct", "variant"))]
    ranked = running_totals(pieces.withColumn("one", F.lit(1)), ["length", *simple], "one", "rank")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    to = arrow_schema(schema)

    def place(batches):
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            k = np.searchsorted(first, rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(base[k] + rank - first[k]), pa.array(offsets[k])], schema=to)

    return ranked.select(*pieces.columns, "rank").mapInArrow(trimmed(place), schema)


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, lean: bool = False) -> DataFrame:
    """Every document's pieces, packed: see token_pieces for null, empty and repeated rows, and pack for empty tables.

    lean: with less memory a task, and more time, for executors whose heap other steps have filled.
    """
    return pack(written(token_pieces(docs, tokenizer_path, capacity, end_id, lean=lean)), capacity)
