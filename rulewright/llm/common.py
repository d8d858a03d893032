"""What several operators of this subpackage need: written tables, sums over a global order."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..reuse import shared_folder, written

__all__ = ["SPACE", "WORD", "arrow_schema", "discard", "fresh", "running_totals", "shared_folder", "trimmed", "written"]

#: White space between words, as the contracts of the operators define it.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores in front if df has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def trimmed(scan: Callable) -> Callable:
    """scan, a function for mapInArrow, after which the worker gives memory it no longer uses back to the machine.

    Spark keeps workers for later tasks, idle ones too; what they hold counts against an executor's memory.
    """

    def run(batches):
        try:
            yield from scan(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # only glibc has it
                pass

    return run


def discard(df: DataFrame) -> None:
    """Removes the files of a written table that no later step reads."""
    files, context = df.inputFiles(), df.sparkSession.sparkContext
    if files:
        folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def running_totals(df: DataFrame, order: list[str | Column], value: str, before: str = "before") -> DataFrame:
    """df with the sum of `value` (no nulls, not negative) over all rows that come earlier in `order`.

    The rows are dealt by range and sorted, so that no task gets more than its share, however many rows
    have one key. Each task sums its own rows; one row a task gives where the next one starts.
    """
    part = fresh(df, "part")
    schema = T.StructType([*df.schema.fields, T.StructField(before, T.LongType()), T.StructField(part, T.IntegerType())])
    to = arrow_schema(schema)

    def scan(batches):
        total, number = 0, TaskContext.get().partitionId()
        for batch in batches:
            values = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(values)
            columns = [*batch.columns, pa.array(total + sums - values, pa.int64()), pa.array(np.full(len(values), number, np.int32))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, to)], schema=to)
            total += int(sums[-1]) if len(sums) else 0

    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(trimmed(scan), schema))
    ends = parts.groupBy(part).agg(F.max(F.col(before) + F.col(value)).alias("size"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(part, F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    start = fresh(parts, "start")
    return (
        parts.join(F.broadcast(starts.withColumnRenamed("start", start)), part)  # a row for each task of the sort
        .withColumn(before, F.col(before) + F.col(start))
        .drop(part, start)
    )
