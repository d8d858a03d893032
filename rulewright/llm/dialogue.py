"""Repair of conversations: the cheapest edits after which roles are an optional system turn and pairs of user and assistant.

A conversation is a path through four states: nothing yet, after a system turn, after a user's, after an assistant's.
The cost to go from a state before a turn is a vector of four, and a turn turns the vector after it into the one before it.
So do pieces of a conversation, as matrices over minimum and sum. Turns are sorted over all tasks, however long one
conversation is; of a conversation that lies in several tasks, each piece sends its matrix, then, with the costs after it known, the state in which it
leaves for each in which it is entered, and is walked at last from the state that the pieces before lead to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from .common import SPACE, arrow_schema, trimmed, written

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: States: 0 nothing yet, 1 after a system turn, 2 after a user's, 3 after an assistant's. The state after the turn that is due:
DUE = (2, 2, 3, 2)
#: Of initials s, u, a and others (0 to 3), where a kept turn leads from each state.
KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
#: A turn's code: its initial, with 4 if it is cut short and 8 if it has to go.
IS_CUT, MUST_GO = 4, 8
#: Costs after the last turn.
AT_END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 50

Vector = tuple[int, ...]


def moves(code: int, state: int) -> list[tuple[str, int, int]]:
    """Edit, cost and next state of what can be done with a turn, in the order of the edits' letters."""
    found = [("D", DELETE, state)]
    if not code & MUST_GO:
        more = CUT if code & IS_CUT else 0
        if state in KEPT[code & 3]:
            found.append(("K", KEEP + more, KEPT[code & 3][state]))
        found.append(("R", REROLE + more, DUE[state]))
    return found


@lru_cache(1 << 16)
def before(after: Vector, code: int) -> Vector:
    """Costs to go before a turn, from those after it; inserted turns may come first."""
    w = [min(cost + after[to] for _, cost, to in moves(code, state)) for state in range(4)]
    user, assistant = min(w[2], INSERT + w[3]), min(w[3], INSERT + w[2])
    return min(w[0], INSERT + user), min(w[1], INSERT + user), user, assistant


def lowered(costs: Vector) -> Vector:
    """costs with the least at 0: only differences decide, and of these there are few."""
    least = min(costs)
    return tuple(min(NEVER, c - least) if c < NEVER else NEVER for c in costs)


@lru_cache(1 << 16)
def walk(after: Vector, code: int, state: int) -> tuple[str, str, int]:
    """The least letters among the cheapest edits up to and with a turn, the initials of the turns made, and the next state."""
    here, edits, made = before(after, code), "", ""
    while True:
        steps = [(e, to) for e, cost, to in moves(code, state) if cost + after[to] == here[state]]
        if INSERT + here[DUE[state]] == here[state] and (not steps or steps[0][0] > "I"):
            steps = [("I", DUE[state])]
        edit, to = steps[0]
        edits += edit
        if edit != "D":
            made += " sua"[to]
        state = to
        if edit != "I":
            return edits, made, state


def at_end(state: int) -> tuple[str, str]:
    """What is inserted after the last turn."""
    return {1: ("II", "ua"), 2: ("I", "a")}.get(state, ("", ""))


def costs_after(codes: np.ndarray, after: Vector) -> list[Vector]:
    """For each turn, the lowered costs after it."""
    out = []
    for code in codes[::-1].tolist():
        out.append(after)
        after = lowered(before(after, code))
    return out[::-1]


@lru_cache(1 << 16)
def row_step(row: Vector, code: int) -> tuple[int, Vector]:
    """Costs of being in each state after one more turn, from those before it: what all have in common, and the rest."""
    inserted = list(row)
    for state in (0, 1):
        inserted[2] = min(inserted[2], row[state] + INSERT)
    inserted[3], inserted[2] = min(row[3], inserted[2] + INSERT), min(inserted[2], row[3] + INSERT)
    out = [NEVER] * 4
    for state in range(4):
        for _, cost, to in moves(code, state):
            out[to] = min(out[to], inserted[state] + cost)
    least = min(out)
    return least, tuple(c - least if c < NEVER else NEVER for c in out)


def matrix(codes: np.ndarray) -> list[int]:
    """Row by row, the least cost of a piece from each state it is entered in to each it leaves in."""
    out = []
    for start in range(4):
        total, row = 0, tuple(0 if s == start else NEVER for s in range(4))
        for code in codes.tolist():
            more, row = row_step(row, code)
            total += more
        out += [total + c if c < NEVER else NEVER for c in row]
    return out


def one_space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows that are left, as crc32 of `conv_id:turn` says; nulls are one space there, and in role and text."""
    kind = F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(one_space("text"), "[.!?]", "")).otherwise(one_space("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(one_space("role"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), F.array_repeat(F.lit(1), times).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("times").alias("time")).drop("time")


def with_faults(turns: DataFrame) -> DataFrame:
    """turns (row, conv_id, turn, role, text) -> row, conv_id, turn, role, digest (of the text), fault (null: none), code."""
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"), F.col("row"))
    slim = turns.select(
        "row", "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"),
        (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"), (~F.col("text").rlike(f"[.!?][{SPACE}]*\\z")).alias("cut"),
    )
    seen = slim.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(order).alias("first"), F.count("*").alias("n"))
    joined = slim.join(seen.where("n > 1"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    repeated = F.coalesce(F.col("first.row") != F.col("row"), F.lit(False))
    fault = F.when(F.col("blank"), "blank").when(repeated, "duplicate").when(F.col("cut"), "truncated")
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    code = initial + F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", IS_CUT).otherwise(0)
    return joined.withColumn("fault", fault).select("row", "conv_id", "turn", "role", "digest", "fault", code.cast("int").alias("code"))


def placed(rows: DataFrame) -> DataFrame:
    """row, conv_id, turn, fault, code, and part and place: the task that has the row in the order of conversation and turn, and its number there."""
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest", "row"]
    fields = "row long, conv_id long, turn long, fault string, code int"
    names = ["row", "conv_id", "turn", "fault", "code", "part", "place"]

    def scan(batches):
        number, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            more = [pa.array(np.full(n, number, np.int32)), pa.array(np.arange(count, count + n), pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:5]), *more], names=names)
            count += n

    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*names[:5])
    return written(sorted_rows.mapInArrow(trimmed(scan), f"{fields}, part int, place long"))


def pieces(table: pa.Table) -> Iterator[tuple[int | None, pa.Table]]:
    """A task's rows in order, conversation by conversation."""
    table = table.sort_by("place")
    ids = table.column("conv_id")
    known, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy()
    edges = np.flatnonzero((known[1:] != known[:-1]) | (null[1:] != null[:-1])) + 1
    for start, end in zip([0, *edges], [*edges, len(known)]):
        yield (None if null[start] else int(known[start])), table.slice(start, end - start)


def codes_of(piece: pa.Table) -> np.ndarray:
    return piece.column("code").to_numpy()


#: Of a task's first and last conversation; of those that lie in several tasks, the costs after the piece, whether it is the last, and the initial before it.
PIECE = [("part", pa.int32()), ("conv_id", pa.int64())]
ENDS = pa.schema([*PIECE, ("matrix", pa.list_(pa.int64())), ("final", pa.int32())])
SPREAD = pa.schema([*PIECE, ("after", pa.list_(pa.int64())), ("last", pa.bool_()), ("initial", pa.int32())])
EXITS = pa.schema([("p", pa.int32()), ("c", pa.int64()), ("exits", pa.list_(pa.int32()))])
ENTERED = SPREAD.append(pa.field("enter", pa.int32()))


def as_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def spread_conversations(turns: DataFrame) -> DataFrame:
    """Of each conversation that lies in several parts, its pieces: part, conv_id, after (costs), enter (state), last, initial (of the turn before, null: none).

    Every table here has at most two rows for each task of the sort, its first and its last conversation, but turns itself.
    """

    def outer(table: pa.Table) -> pa.Table:
        found = list(pieces(table))
        ends = found[:1] + found[1:][-1:]
        part = table.column("part")[0].as_py()
        return as_table([(part, conv, matrix(c := codes_of(p)), int(c[-1]) & 3) for conv, p in ends], ENDS)

    def backward(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part")
        if len(rows) < 2:
            return as_table([], SPREAD)
        after, costs = AT_END, []
        for m in reversed(rows.column("matrix").to_pylist()):
            costs.append(list(after))
            after = lowered(tuple(min(m[4 * s + t] + after[t] for t in range(4)) for s in range(4)))
        part, conv, final = (rows.column(c).to_pylist() for c in ("part", "conv_id", "final"))
        return as_table([(p, c, v, p == part[-1], f) for p, c, v, f in zip(part, conv, costs[::-1], [None, *final])], SPREAD)

    def exits(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        codes, out = codes_of(table), [0, 1, 2, 3]
        for code, after in zip(codes.tolist(), costs_after(codes, tuple(table.column("after")[0].as_py()))):
            out = [walk(after, code, s)[2] for s in out]
        return as_table([(key[0].as_py(), key[1].as_py(), out)], EXITS)

    def forward(table: pa.Table) -> pa.Table:
        state, out = 0, []
        for *own, exits in zip(*(table.sort_by("part").column(c).to_pylist() for c in ("part", "conv_id", "after", "last", "initial", "exits"))):
            out.append((*own, state))
            state = exits[state]
        return as_table(out, ENTERED)

    slim = turns.select("part", "place", "conv_id", "code")
    found = slim.groupBy("part").applyInArrow(outer, from_arrow_schema(ENDS))
    found = written(found.groupBy("conv_id").applyInArrow(backward, from_arrow_schema(SPREAD)))
    own = found.select(F.col("part").alias("p"), F.col("conv_id").alias("c"), "after")
    here = (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c"))
    both = slim.join(F.broadcast(own), here).select("part", "conv_id", "place", "code", "after")
    left = both.groupBy("part", "conv_id").applyInArrow(exits, from_arrow_schema(EXITS))
    return written(found.join(left, here).drop("p", "c").groupBy("conv_id").applyInArrow(forward, from_arrow_schema(ENTERED)))


EDITED = "row long, conv_id long, turn long, fault string, part int, place long, edits string, made string, illegal boolean"


def edited(turns: DataFrame) -> DataFrame:
    """placed() turns with edits, made (initials of the turns that come of it) and illegal (whether the roles of the turn before and its own don't follow one another)."""
    schema = arrow_schema(T.StructType.fromDDL(EDITED))
    spread = spread_conversations(turns).select(F.col("part").alias("p"), F.col("conv_id").alias("c"), "after", "last", "initial", "enter")
    joined = turns.join(F.broadcast(spread), (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("p", "c")

    def edit(table: pa.Table) -> pa.Table:
        edits, made, illegal, parts = [], [], [], []
        for _, piece in pieces(table):
            codes, known = codes_of(piece), piece.column("enter")[0].as_py() is not None
            after = tuple(piece.column("after")[0].as_py()) if known else AT_END
            state = piece.column("enter")[0].as_py() if known else 0
            ends = piece.column("last")[0].as_py() if known else True
            previous = piece.column("initial")[0].as_py()
            for code, costs in zip(codes.tolist(), costs_after(codes, after)):
                letters, initials, state = walk(costs, code, state)
                edits.append(letters)
                made.append(initials)
                illegal.append(previous is not None and (previous, code & 3) not in ((0, 1), (1, 2), (2, 1)))
                previous = code & 3
            if ends:
                letters, initials = at_end(state)
                edits[-1] += letters
                made[-1] += initials
            parts.append(piece)
        rows = pa.concat_tables(parts)
        more = [pa.array(edits, pa.string()), pa.array(made, pa.string()), pa.array(illegal, pa.bool_())]
        return pa.Table.from_arrays([*(rows.column(c) for c in schema.names[:6]), *more], names=schema.names).cast(schema)

    return joined.groupBy("part").applyInArrow(edit, EDITED)


def repaired(conversations: DataFrame) -> DataFrame:
    """Every turn of conversations (conv_id, turn, role, text), damaged() before, with its role and text, place in its conversation (part, place), fault, illegal,
    edits (letters in order: inserted turns before it, its own, inserted ones at the end), made (initials of the turns these make).

    Turns are in the order of turn, nulls first, and where these are equal of role, the text's SHA-256, and rows alike. A null
    conv_id is a conversation. Null roles and texts are one space; an empty role has no initial; texts are compared whole, by SHA-256; repeated
    rows are duplicates. A conversation may be of any length. An empty table gives an empty one; other columns play no part.
    """
    whole = written(damaged(conversations).withColumn("row", F.monotonically_increasing_id()))
    found = edited(placed(with_faults(whole)))
    return found.join(whole.select("row", "role", "text"), "row").drop("row")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """repaired() rows -> conv_id, part, place, step, role, text: the turns of the repaired conversations, in the order of part, place and step."""
    steps = F.filter(F.split("edits", ""), lambda e: e != "")
    each = rows.select("*", F.posexplode(steps).alias("at", "edit")).where("edit != 'D'")
    step = F.length(F.regexp_replace(F.substring("edits", F.lit(1), F.col("at")), "D", ""))
    named = F.when(F.substring("made", step + 1, F.lit(1)) == "u", "user").otherwise("assistant")
    role = F.when(F.col("edit") == "K", F.col("role")).otherwise(named)
    return each.select("conv_id", "part", "place", step.alias("step"), role.alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, audit and repaired_sha256 of repaired() rows. A digest takes its bytes in order, so that one task reads a conversation, one batch after another."""

    def scan(batches):
        state = None  # conversation, digest, edits, whether a turn came

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(["".join(r[2]) for r in rows], pa.string()), pa.array([r[1].hexdigest() for r in rows], pa.string())], names=["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            ended = []
            for conv, edits, made, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edits", "made", "role", "text"))):
                if state is None or state[0] != conv:
                    if state:
                        ended.append(state)
                    state = [conv, hashlib.sha256(), [], False]
                state[2].append(edits)
                turns = iter(made)
                for edit in edits:
                    if edit == "D":
                        continue
                    initial = next(turns)
                    line = f"{role if edit == 'K' else 'user' if initial == 'u' else 'assistant'}:{'' if edit == 'I' else text}"
                    state[1].update(("\n" + line if state[3] else line).encode())
                    state[3] = True
            if ended:
                yield out(ended)
        if state:
            yield out([state])

    order = [F.asc_nulls_first("conv_id"), "part", "place"]
    dealt = rows.select("conv_id", "part", "place", "edits", "made", "role", "text").repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(trimmed(scan), "conv_id long, audit string, repaired_sha256 string")


def conversation_reports(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of conversations, also where no turn is left: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = written(repaired(conversations))
    letters = lambda x: F.length("edits") - F.length(F.replace(F.col("edits"), F.lit(x)))
    cut = (F.col("fault") == "truncated") & ~F.col("edits").contains("D")
    cost = DELETE * letters("D") + INSERT * letters("I") + REROLE * letters("R") + F.when(cut, CUT).otherwise(0)
    faults = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    sums = rows.groupBy("conv_id").agg(gaps.alias("gaps"), *faults, F.count_if("illegal").alias("illegal"), F.sum(cost).alias("cost"))
    sums = sums.withColumnRenamed("conv_id", "c")
    read = digests(rows).withColumnRenamed("conv_id", "d")
    every = conversations.select(F.col("conv_id").cast("long")).distinct()
    joined = every.join(sums, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(read, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
