"""What runs leave behind: versioned tables, manifests, logs, annotation files. Parquet in folders, by Spark's writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The shape of stored tables; a store of a newer one is refused.
SCHEMA_VERSION = 7
MANIFEST = "run string, command string, corpus string, corpus_revision string, alphabet_version int, thresholds string, seed int, revision string, segmenter string, at timestamp"


def open_store(spark: SparkSession, folder: str) -> int:
    """The version of the store in a folder, which is marked if it is new."""
    marker = f"{folder}/schema_version"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(marker)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([(SCHEMA_VERSION,)], "version int").coalesce(1).write.parquet(marker)
        return SCHEMA_VERSION
    version = spark.read.parquet(marker).agg(F.max("version")).first()[0]
    if version > SCHEMA_VERSION:
        raise ValueError(f"the store has version {version}, this engine knows {SCHEMA_VERSION}")
    return version


def record_run(spark: SparkSession, folder: str, run: dict, thresholds: object) -> None:
    """Appends a row for a command: what it read and by which thresholds."""
    row = run | {"thresholds": json.dumps(vars(thresholds), sort_keys=True)}
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    spark.createDataFrame([tuple(row.get(n) for n in names)], MANIFEST).withColumn("at", F.coalesce("at", F.current_timestamp())).write.mode("append").parquet(f"{folder}/runs")


def log_answers(answers: DataFrame, folder: str, source: str) -> None:
    """Appends answers to the decision log, under what gave them (live, replay)."""
    answers.withColumns({"source": F.lit(source), "at": F.current_timestamp()}).write.mode("append").partitionBy("source").parquet(f"{folder}/decisions")


def replace_answers(answers: DataFrame, folder: str, source: str) -> None:
    """The same, in place of what this source gave before; other sources' rows stay."""
    rows = answers.withColumns({"source": F.lit(source), "at": F.current_timestamp()})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{folder}/decisions")


def insert_once(rows: DataFrame, folder: str, keys: list[str]) -> None:
    """Appends the rows whose keys aren't stored yet."""
    try:
        stored = rows.sparkSession.read.parquet(folder).select(*keys)
    except Exception as error:  # nothing is stored yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = rows.select(*keys).limit(0)
    rows.dropDuplicates(keys).join(stored, keys, "left_anti").write.mode("append").parquet(folder)


def write_annotations(lines: DataFrame, folder: str, partial: bool = False) -> str:
    """JSON lines in the order of their sites, in parts by range; returns the folder, which says if the set is partial."""
    where = f"{folder}.partial" if partial else folder
    lines.repartitionByRange("interaction", "episode", "seq", "pred").sortWithinPartitions("interaction", "episode", "seq", "pred").write.mode("overwrite").json(where)
    return where


def redaction_preview(sites: DataFrame, raw: DataFrame, folder: str) -> None:
    """The different texts before and after redaction, for a person to look at; nothing is sent anywhere."""
    pairs = sites.join(raw.select("interaction", "episode", "seq", F.col("text").alias("before")), ["interaction", "episode", "seq"])
    pairs.select("sha", "before", F.col("text").alias("after")).dropDuplicates(["sha"]).write.mode("overwrite").json(folder)
