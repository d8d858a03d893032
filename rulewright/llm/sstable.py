"""Token ids in sorted-string-table shards that Spark writes in key order, one task a shard.

A shard is a file of blocks, a sparse index, a Bloom filter and a footer, all little-endian:

    block   entries in key order: shared, rest and value length (varints), rest of the key, value. The first
            entry of a block shares nothing; later ones leave out what they share with the key before.
    index   for each block: key length (u16), first key, offset (u64), size (u32)
    filter  k (u32), number of bits (u64), bits
    footer  index and filter offset, entries, ids (u64 each), bytes an id (u32), MAGIC

A key is a byte (0: null, 1: not null), then the document id as 8 bytes, big-endian, sign bit turned, so that
byte order is id order. Repeated ids are repeated entries. A value is the ids as unsigned integers of 2 bytes, or
of 4 if the vocabulary is larger than 65,536.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, trimmed
from .tokens import SLICE, encoder

MAGIC = b"SSTSHARD"
FOOTER = struct.Struct("<QQQQI8s")
FOOTER_BYTES = FOOTER.size
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 64 << 20
BITS_A_KEY, HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) % (1 << 64))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def bloom_places(keys: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """A row of places for each key, given as (n, 9) bytes: two mixes of the key, stepped."""
    with np.errstate(over="ignore"):
        x = keys[:, 1:].copy().view(">u8").ravel().astype(np.uint64) + keys[:, 0].astype(np.uint64)
        mixed = []
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            y = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
            y = (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed.append(y ^ (y >> np.uint64(32)))
        step = np.arange(hashes, dtype=np.uint64)
        return (mixed[0][:, None] + step * (mixed[1] | np.uint64(1))[:, None]) % np.uint64(bits)


class ShardWriter:
    """Entries, in key order, to an open binary file."""

    def __init__(self, out, id_bytes: int):
        self.out, self.id_bytes = out, id_bytes
        self.block, self.last, self.offset, self.first = bytearray(), b"", 0, b""
        self.index, self.keys, self.ids = bytearray(), [], 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        value = ids.astype(f"<u{self.id_bytes}").tobytes()
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            self.index += struct.pack("<H", len(self.first)) + self.first + struct.pack("<QI", self.offset, len(self.block))
            self.out.write(bytes(self.block))
            self.offset += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self.flush()
        bits = max(64, BITS_A_KEY * len(self.keys))
        filter_ = np.zeros(bits, np.uint8)
        if self.keys:
            filter_[bloom_places(np.frombuffer(b"".join(self.keys), np.uint8).reshape(-1, 9), bits, HASHES).ravel()] = 1
        packed = struct.pack("<IQ", HASHES, bits) + np.packbits(filter_, bitorder="little").tobytes()
        at = self.offset
        self.out.write(bytes(self.index) + packed)
        self.out.write(FOOTER.pack(at, at + len(self.index), len(self.keys), self.ids, self.id_bytes, MAGIC))


class Shard:
    """A shard's bytes: `get(doc_id)` by filter, binary search of the index and one block; `items()` in key order."""

    def __init__(self, data: bytes):
        self.data = memoryview(data).cast("B")
        index, filter_, self.entries, self.ids, self.id_bytes, magic = FOOTER.unpack(self.data[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.firsts, self.blocks, at = [], [], index
        while at < filter_:
            n = struct.unpack_from("<H", self.data, at)[0]
            self.firsts.append(bytes(self.data[at + 2 : at + 2 + n]))
            self.blocks.append(struct.unpack_from("<QI", self.data, at + 2 + n))
            at += 14 + n
        self.hashes, self.bits = struct.unpack_from("<IQ", self.data, filter_)
        self.filter = np.frombuffer(self.data, np.uint8, (self.bits + 7) // 8, filter_ + 12)

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, size = self.blocks[k]
        end, key = at + size, b""
        while at < end:
            shared, at = read_varint(self.data, at)
            rest, at = read_varint(self.data, at)
            size, at = read_varint(self.data, at)
            key = key[:shared] + bytes(self.data[at : at + rest])
            at += rest
            yield key, np.frombuffer(self.data, f"<u{self.id_bytes}", size // self.id_bytes, at)
            at += size

    def items(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.blocks)):
            for key, ids in self._block(k):
                yield id_of(key), ids

    def may_hold(self, doc_id: int | None) -> bool:
        places = bloom_places(np.frombuffer(key_of(doc_id), np.uint8).reshape(1, 9), self.bits, self.hashes)[0].astype(np.int64)
        return bool((self.filter[places >> 3] >> (places & 7) & 1).all())

    def get(self, doc_id: int | None) -> np.ndarray | None:
        key = key_of(doc_id)
        if not self.may_hold(doc_id):
            return None
        k = bisect_right(self.firsts, key) - 1
        while k > 0 and self.firsts[k] == key:  # a repeated id may begin in the block before
            k -= 1
        for block in range(max(k, 0), len(self.blocks)):
            if self.firsts[block] > key:
                break
            for other, ids in self._block(block):
                if other == key:
                    return ids
        return None


def ids_in(footer: bytes) -> int:
    return FOOTER.unpack(footer)[3]


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> str:
    """Encodes `text` (null: empty) of every row, appends end_id, and writes shards in ascending doc_id order.

    Returns the folder; its shards' names sort as their keys do. Nulls of doc_id come first; repeated ids and rows
    all stay; other columns play no part; an empty table gives no shard. A shard gets its name when it is whole, so
    that a repeated task only replaces it by the same; a task begins another after SHARD_BYTES.
    """
    folder = folder or shared_folder(docs.sparkSession)

    def write(batches):
        from pyarrow import fs as arrow_fs

        fs, path = arrow_fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        codes = encoder(tokenizer_path)
        id_bytes = 2 if max(codes.tokenizer.get_vocab_size(), end_id) <= 1 << 16 else 4
        context, writer, shards, number = TaskContext.get(), None, [], 0

        def close():
            writer.close()
            writer.out.close()
            fs.move(f"{path}/{name}.{context.taskAttemptId()}", f"{path}/{name}.sst")
            shards.append((name, len(writer.keys), writer.ids))

        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, len(b), SLICE)):
            for doc_id, ids in zip(batch.column(0).to_pylist(), codes.encode(batch.column(1).to_pylist())):
                if writer is None:
                    name = f"shard-{context.partitionId():06d}-{number:04d}"
                    writer, number = ShardWriter(fs.open_output_stream(f"{path}/{name}.{context.taskAttemptId()}"), id_bytes), number + 1
                writer.add(key_of(doc_id), np.append(ids, np.uint32(end_id)))
                if writer.offset >= SHARD_BYTES:
                    close()
                    writer = None
        if writer is not None:
            close()
        if shards:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*shards)], names=["shard", "documents", "ids"])

    # rows of one doc_id, or of none, are told apart, so that they too are dealt over many tasks
    order = ["doc_id", "content", "place"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("content"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(trimmed(write), "shard string, documents long, ids long").agg(F.sum("documents")).collect()  # one number
    return folder


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each entry: doc_id, start (ids of all entries before it), n_tokens, ids_crc32, and its ids' shard."""
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile")
    files = files.option("pathGlobFilter", "*.sst").load(folder).withColumn("shard", F.regexp_extract("path", r"([^/]+)\.sst$", 1))

    def totals(batches):
        """Of footers alone, which are read at their place."""
        from pyarrow import fs as arrow_fs

        fs, path = arrow_fs.FileSystem.from_uri(folder)
        for batch in batches:
            found = []
            for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{path}/{name}.sst") as file:
                    file.seek(length - FOOTER_BYTES)
                    found.append(ids_in(file.read(FOOTER_BYTES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["shard", "ids"])

    def entries(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, before, counts, crcs, total = [], [], [], [], 0
                for doc_id, values in Shard(content.as_buffer()).items():
                    ids.append(doc_id)
                    before.append(total)
                    counts.append(len(values))
                    crcs.append(zlib.crc32(values.astype("<u4").tobytes()))
                    total += len(values)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), *(pa.array(x, pa.int64()) for x in (ids, before, counts, crcs))], names=["shard", "doc_id", "before", "n_tokens", "ids_crc32"])

    sizes = files.select("shard", "length").mapInArrow(trimmed(totals), "shard string, ids long")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    first = sizes.select("shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("first"))
    rows = files.select("shard", "content").mapInArrow(trimmed(entries), "shard string, doc_id long, before long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(first), "shard").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard")


def lookup(spark: SparkSession, folder: str, doc_ids: list[int | None]) -> DataFrame:
    """The ids of some documents, found in each shard by its filter and index: doc_id, ids array<long>."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder).select("content")

    def find(batches):
        for batch in batches:
            for content in batch.column(0):
                shard = Shard(content.as_buffer())
                found = [(i, ids.tolist()) for i in doc_ids if (ids := shard.get(i)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return files.mapInArrow(trimmed(find), "doc_id long, ids array<long>")
