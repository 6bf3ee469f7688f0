"""Reading series, segments and tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import segment_id
from ..series import join_small, series

SIGNAL_NAMES = {"acoustic_data": "s", "time_to_failure": "ttf"}  # fixed names of the training file
SIGNAL_SCHEMA = T.StructType([T.StructField("s", T.ShortType()), T.StructField("ttf", T.FloatType())])


def rename_signal(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(SIGNAL_NAMES)


def read_by_extension(spark: SparkSession, path: str, schema: T.StructType | None = None, fallback: str | None = None) -> DataFrame:
    """Parquet, ORC, JSON or CSV (with header) by the extension of the path; ``fallback`` is used for any other."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in (".parquet", ".orc", ".json", ".jsonl", ".csv") and fallback:
        ext = "." + fallback
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if ext == ".parquet":
        return reader.parquet(path)
    if ext == ".orc":
        return reader.orc(path)
    if ext in (".json", ".jsonl"):
        return reader.json(path)
    if ext == ".csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    raise ValueError(f"extension {ext!r} not found")


def file_positions(df: DataFrame) -> DataFrame:
    """Add ``pos``: the row number inside each source file, for text files that carry no key.

    A split is read front to back by one task, so the row counts of the splits of a file, in split
    order, give the offset of each split.  Only that small table is aggregated; rows are not sorted.
    """
    src = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
                    F.monotonically_increasing_id().alias("_id"))
    splits = src.groupBy("_file", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_at", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return join_small(src, splits, ["_file", "_at"]).withColumn("pos", F.col("_id") + F.col("_shift")).drop("_file", "_at", "_id", "_shift")


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """Signal and label from CSV (header line, typed, renamed by position) as a series table."""
    raw = spark.read.schema(SIGNAL_SCHEMA).csv(path, header=True, enforceSchema=True)
    return series(file_positions(raw), "pos", "s", label="ttf")


def read_segments(spark: SparkSession, directory: str, column: str = "acoustic_data", recursive: bool = False, folder_key: str | None = None) -> DataFrame:
    """Every ``*.csv`` of a directory as one short series, named after its file: one scan for all.

    ``folder_key`` names the segments after the folder ``<folder_key>=<name>`` they lie in, as partitioned writes lay them out.
    """
    raw = (spark.read.schema(f"{column} double").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", recursive)
           .csv(directory, header=True, enforceSchema=True))
    name = segment_id(F.col("_metadata.file_name")) if folder_key is None else F.regexp_extract("_metadata.file_path", f"/{folder_key}=([^/]*)/", 1)
    numbered = file_positions(raw.select("*", name.alias("_name"), "_metadata"))
    return series(numbered, "pos", column, "_name")


def find_files(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """``path, length`` of the files below a directory whose names match a glob pattern (contents are not read)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
            .load(directory).select("path", "length"))


def read_cycles(spark: SparkSession, path: str, only: list[int] | None = None, exclude: list[int] = ()) -> DataFrame:
    """Cycles written by ``write_cycles``; the filters prune partitions."""
    df = spark.read.parquet(path)
    if only is not None:
        df = df.filter(F.col("cycle_id").isin(list(only)))
    return df.filter(~F.col("cycle_id").isin(list(exclude))) if exclude else df


def is_segment_file(name):
    return F.endswith(name, F.lit(".csv"))

