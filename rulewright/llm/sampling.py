"""A bounded, repeatable sample of labelled rows for a classifier."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = float(1 << 63)


def labelled_sample(rows: DataFrame, label: str, key: Column, most: int) -> tuple[pd.DataFrame, dict]:
    """About `most` rows (never more) of each label, those of the least hash of `key`, and each label's count of all rows.

    Labels are few. Only the sample comes to the driver, in an order that doesn't depend on Spark's partitions.
    """
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}  # a row for each label
    if not counts:
        return rows.toPandas(), counts
    part = F.coalesce(*(F.when(F.col(label) == k, F.lit(min(1.0, 1.2 * most / n))) for k, n in sorted(counts.items())))
    place = (F.xxhash64(key, F.lit(11)) / UNIT + 1) / 2
    taken = rows.withColumn("place_", place).where(F.col("place_") <= part).toPandas().sort_values(["place_", *rows.columns], kind="stable")
    taken = taken.groupby(label, sort=True).head(most).drop(columns="place_").reset_index(drop=True)
    return taken, counts


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; null for a null id."""
    return F.crc32(doc_id.cast("string")) % by
