"""SimHash near-duplicates: fingerprints, and a self-join of their binary trie within a Hamming budget.

The trie is walked by pairs of nodes of one depth, with the bits in which they differ so far; a pair over the budget
goes no further. From its root that walk meets nearly every pair of shallow nodes. So there is a trie for each
choice of `matched` of the fingerprint's blocks, with these blocks' bits on top: at most `budget` bits in `blocks`
blocks leave blocks - budget of them alike, hence each linked pair goes down the top of some trie through the same
nodes. These tops are the keys by which Spark deals fingerprints out; below them, tasks walk pairs of nodes.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, trimmed, written
from .components import components
from .tokens import forget

BITS = 64
#: Fingerprints of one top that one task walks together; more are dealt in chunks, each pair of chunks to a task.
CHUNK = 4096
#: Pairs of nodes that a walk takes one bit further at once.
FRONTIER = 1 << 17
#: Such tops are told to all tasks if they are no more than this, else joined.
BROADCAST_TOPS = 100_000


def simhash(text: bytes, words: int, seed: int) -> int:
    """A bit is 1 if it is in more than half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = [0, *ends[: max(0, len(parts) - words)].tolist()]
    stops = (ends[min(words, len(parts)) - 1 :] - 1).tolist()
    counts, step = np.zeros(BITS, np.int64), 1 << 16
    for at in range(0, len(starts), step):
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + step], stops[at : at + step])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """docs' doc_id with `bits`: the SimHash of the whole text (null: as empty, 0) as a signed long."""

    def scan(batches):
        forget()
        for batch in batches:
            found = [simhash(x.as_buffer().to_pybytes() if x.is_valid else b"", words, seed) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "bits"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(scan), "doc_id long, bits long")


def find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def trie_pairs(bits: np.ndarray, tops: np.ndarray, sides: np.ndarray | None, budget: int, depth: int, labels: np.ndarray | None = None):
    """All links (pairs at most `budget` bits apart) within each group of equal `tops`, each once, as arrays (i, j).

    bits: the `depth` bits below the top, sorted by (top, bits). Nodes are runs of this order. Where `sides` holds 0
    and 1, only pairs with both count; where there are `labels`, only pairs of two labels do, and two nodes all of
    one label go no further. All tops are walked at once: a frontier of pairs of nodes with their differing bits goes
    down bit by bit; a pair of single fingerprints is settled by counting its bits.
    """
    n = len(bits)
    cuts = np.flatnonzero(np.append(True, tops[1:] != tops[:-1])) if n else np.zeros(0, np.int64)
    a0, a1 = cuts, np.append(cuts[1:], n)
    frontier = [(a0, a1, a0, a1, np.zeros(len(cuts), np.int64), depth)] if n else []
    changes = None if labels is None else np.append(0, np.cumsum(labels[1:] != labels[:-1]))

    def settle(i, j):
        near = (i < j) & (np.bitwise_count(bits[i] ^ bits[j]) <= budget)  # of two nodes, i's comes first
        if sides is not None:
            near &= sides[i] != sides[j]
        if labels is not None:
            near &= labels[i] != labels[j]
        return i[near], j[near]

    while frontier:
        a0, a1, b0, b1, diff, left = frontier.pop()
        if len(a0) > FRONTIER:  # bounds what a task holds; the rest waits
            half = len(a0) // 2
            frontier += [(a0[:half], a1[:half], b0[:half], b1[:half], diff[:half], left), (a0[half:], a1[half:], b0[half:], b1[half:], diff[half:], left)]
            continue
        small = (a1 - a0) * (b1 - b0) <= 4
        i, wide, j0 = a0[small], (b1 - b0)[small], b0[small]
        size = (a1 - a0)[small] * wide
        if len(size):
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            wide_, i_, j_ = (np.repeat(x, size) for x in (wide, i, j0))
            yield settle(i_ + k // wide_, j_ + k % wide_)
        a0, a1, b0, b1, diff = (x[~small] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        if left:
            left -= 1
            bit, step = np.uint64(1) << np.uint64(left), 1
            ones = np.append(0, np.cumsum((bits & bit) != 0))  # a run is sorted: its zeros come first
            a, b = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        else:  # rows of equal bits: halves of them stand for nodes
            a, b, step = (a0 + a1) // 2, (b0 + b1) // 2, 0
        same = (a0 == b0) & (a1 == b1)
        pairs = [(a0, a, b0, b, diff), (a, a1, b, b1, diff), (a0, a, b, b1, diff + step)]
        pairs.append(tuple(x[~same] for x in (a, a1, b0, b, diff + step)))
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*pairs))
        go = (a1 > a0) & (b1 > b0) & (diff <= budget)
        a0, a1, b0, b1, diff = (x[go] for x in (a0, a1, b0, b1, diff))
        if changes is not None:
            go = (changes[a1 - 1] != changes[a0]) | (changes[b1 - 1] != changes[b0]) | (labels[a0] != labels[b0])
            a0, a1, b0, b1, diff = (x[go] for x in (a0, a1, b0, b1, diff))
        frontier.append((a0, a1, b0, b1, diff, left))


def spanning(n: int, pairs):
    """Of pairs of 0 to n - 1 (arrays), those that span their groups; those that add no connection are not."""
    parent = np.arange(n)
    for i, j in pairs:
        links = []
        for x, y in zip(i.tolist(), j.tolist()):
            p, q = find(parent, x), find(parent, y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                links.append((x, y))
        yield tuple(np.array(links, np.int64).reshape(-1, 2).T)


def near_links(prints: DataFrame, budget: int = 4, blocks: int = 6) -> DataFrame:
    """a, b: links between rows of `prints` (bits: distinct) at most `budget` bits apart.

    Of each trie's top, links that span its groups are kept; those that add no connection are not. Chunks of a
    top with more than CHUNK fingerprints meet pairwise, so that no task has an unbounded one: a row of it is copied
    to as many tasks as the top has chunks, at worst (all fingerprints in one top) to n / CHUNK of them.
    """
    matched = blocks - budget
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    choices = list(combinations(range(blocks), matched))
    masks = [sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in c) for c in choices]
    signed = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in masks))
    top = F.col("bits").bitwiseAND(F.element_at(signed, F.col("trie") + 1))
    rows = prints.select("bits", F.explode(F.sequence(F.lit(0), F.lit(len(choices) - 1))).alias("trie"))
    # counted by a hash of the top: two that share one are at worst dealt in chunks though neither is large
    large = rows.groupBy(F.hash("trie", top).alias("h")).count().where(F.col("count") > CHUNK)
    large = written(large.select("h", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")))
    few = large.count() <= BROADCAST_TOPS
    rows = rows.join(F.broadcast(large) if few else large, F.hash("trie", top) == F.col("h"), "left").drop("h")
    own = F.pmod(F.xxhash64("bits"), F.coalesce("chunks", F.lit(1))).cast("int")
    # with itself (as i, i) and with each other chunk
    meets = F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda c: F.struct(F.least(c, own).alias("i"), F.greatest(c, own).alias("j")))
    )
    rows = rows.withColumn("own", own).withColumn("meet", F.explode(meets)).select("trie", "meet.i", "meet.j", "own", "bits")

    def lower(bits: np.ndarray, trie: int) -> tuple[np.ndarray, int]:
        """The bits outside the top, moved together."""
        out, depth = np.zeros(len(bits), np.uint64), 0
        for k in range(blocks):
            if k not in choices[trie]:
                width = edges[k + 1] - edges[k]
                out |= (bits >> np.uint64(edges[k]) & np.uint64((1 << width) - 1)) << np.uint64(depth)
                depth += width
        return out, depth

    mask = np.array(masks, np.uint64)

    def links_of(trie, i, j, own, bits):
        """Of whole groups of (trie, top, i, j)."""
        for t in np.unique(trie):
            for two in (False, True):
                at = np.flatnonzero((trie == t) & ((i != j) == two))
                if not len(at):
                    continue
                low, depth = lower(bits[at].view(np.uint64), int(t))
                held = np.stack([bits[at].view(np.uint64) & mask[t], i[at].astype(np.uint64), j[at].astype(np.uint64)])
                order = np.lexsort((low, *held[::-1]))
                held, at = held[:, order], at[order]
                number = np.cumsum(np.append(False, (held[:, 1:] != held[:, :-1]).any(axis=0)))
                pairs = trie_pairs(low[order], number, own[at] != i[at] if two else None, budget, depth)
                for x, y in spanning(len(at), pairs):
                    yield bits[at[x]], bits[at[y]]

    def walk(batches):
        def emit(table):
            held, size = [], 0
            for x, y in links_of(*table):
                held.append((x, y))
                size += len(x)
                if size > 1 << 18:
                    yield batch_of(held)
                    held, size = [], 0
            if size:
                yield batch_of(held)

        def batch_of(held):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*held)], names=["a", "b"])

        forget()
        rest = None
        for batch in batches:
            table = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            if rest is not None:
                table = [np.concatenate(x) for x in zip(rest, table)]
            trie, i, j, _, bits = table
            group = np.stack([trie.astype(np.uint64), bits.view(np.uint64) & mask[trie], i.astype(np.uint64), j.astype(np.uint64)])
            change = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0))
            cut = change[-1] + 1 if len(change) and len(trie) > 1 << 16 else 0  # the last group may go on
            if cut:
                yield from emit([x[:cut] for x in table])
            rest = [x[cut:] for x in table]
        if rest is not None and len(rest[0]):
            yield from emit(rest)

    return rows.repartition("trie", top, "i", "j").sortWithinPartitions("trie", top, "i", "j").mapInArrow(trimmed(walk), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, budget: int = 4, seed: int = 42, blocks: int = 6) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, for every row of docs.

    component_id is the smallest doc_id that links of at most `budget` differing bits lead to, itself included.
    Rows of one fingerprint are one node of the links, so that copies cost one row. Null and empty texts have
    fingerprint zero and are linked like others. A row without doc_id gets its component's smallest doc_id, or null if
    all are null. Repeated rows stay. Other columns of docs play no part.
    """
    prints = written(fingerprints(docs, words, seed))
    nodes = written(prints.groupBy("bits").agg(F.min("doc_id").alias("first")))
    # a fingerprint is its own node: the signed bits name it even where no doc_id does
    links = written(near_links(nodes.select("bits"), budget, blocks))
    groups = components(links)
    member = nodes.join(groups, F.col("bits") == F.col("node"), "left").select("bits", "first", F.coalesce("component", "bits").alias("component"))
    ids = member.groupBy("component").agg(F.min("first").alias("component_id"))
    table = member.join(ids, "component").select(F.col("bits").alias("print"), "component_id")
    joined = prints.join(table, F.col("bits") == F.col("print"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
