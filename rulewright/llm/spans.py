"""Words and lines of many texts at once, found in their UTF-8 bytes with numpy and Arrow."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are looked at together; a longer text is looked at alone.
SLICE_BYTES = 4 << 20


def byte_table(keep) -> np.ndarray:
    """For each of the 256 bytes, whether keep holds of it."""
    return np.array([bool(keep(b)) for b in range(256)])


#: Bytes that are not white space between words; not a line's end.
IN_WORD = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
IN_LINE = byte_table(lambda b: b != 0x0A)
#: First bytes of characters.
LEADS = byte_table(lambda b: b & 0xC0 != 0x80)


@dataclass
class Texts:
    """Texts one after another: their bytes, and where each begins; one place more than there are texts."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def totals(self, flags: np.ndarray) -> np.ndarray:
        """For each text, the sum of what flags has for its bytes."""
        return sums(flags, self.offsets)


@dataclass
class Runs:
    """Longest runs of bytes of one kind, none across two texts: their bytes, the first byte's place, and how many each text has."""

    bytes: pa.Array
    starts: np.ndarray
    lengths: np.ndarray
    counts: np.ndarray

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets that follow one another."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def texts_of(column: pa.Array) -> Texts:
    """Null is the empty text."""
    whole = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = whole.buffers()
    offsets = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in pieces with at most so many bytes in `column`, or with one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def runs(texts: Texts, kind: np.ndarray) -> Runs:
    """The runs of bytes for which kind is true."""
    inside = kind[texts.data]
    goes_on = np.zeros(len(inside), bool)
    goes_on[1:] = inside[:-1]
    goes_on[texts.offsets[:-1][texts.offsets[:-1] < len(inside)]] = False
    starts = np.flatnonzero(inside & ~goes_on)
    kept = texts.data[inside]
    places = np.append(np.cumsum(inside, dtype=np.int64)[starts] - 1, len(kept))
    counts = np.diff(np.searchsorted(starts, texts.offsets))
    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(kept)])
    return Runs(made, starts, np.diff(places), counts)


def named(values: np.ndarray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each of values, from 0, equal ones alike; and the distinct values by number."""
    found = (values if isinstance(values, pa.Array) else pa.array(values)).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
