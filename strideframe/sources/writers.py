"""Writing feature tables, cycles, predictions, summaries and submissions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import read_by_extension, rename_signal


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def convert_signal(spark: SparkSession, source: str, target: str) -> None:
    """CSV signal to parquet under the canonical column names."""
    rename_signal(read_by_extension(spark, source)).write.mode("overwrite").parquet(target)


def write_cycles(cycles: DataFrame, path: str) -> None:
    """One directory per cycle; each cycle may be written by many tasks."""
    cycles.write.mode("overwrite").partitionBy("cycle_id").parquet(path)


def write_segments(rows: DataFrame, path: str, key: str, order: str, column: str) -> int:
    """One CSV file of ``column`` per ``key``, in ``order``, as ``path/<key>=<value>/part-*.csv``; returns the number of files.

    The layout and lines are those of ``write.partitionBy(key).csv``: a null key is ``__HIVE_DEFAULT_PARTITION__``, a null value no
    line.  On a file system without native Hadoop, Spark's writer starts several processes per file to set its permissions; here
    each task streams its rows into one file after another.  A file appears under its name when it is whole.
    """
    spark = rows.sparkSession
    name = F.coalesce(F.col(key).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    lines = (rows.repartition(key).sortWithinPartitions(key, order).select(name.alias("name"), F.col(column).cast("string").alias("line")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, at, n = None, None, 0

        def close() -> None:
            out.close()
            final = f"{root}/{key}={at}/part-{task:05d}.csv"
            if files.get_file_info(final).type != pa.fs.FileType.NotFound:  # of an attempt before
                files.delete_file(final)
            files.move(f"{root}/{key}={at}/.{attempt}", final)

        for b in batches:
            names = b.column(0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else []
            for lo, hi in zip(starts, [*starts[1:], len(names)]):
                if names[lo] != at:
                    if out is not None:
                        close()
                    at, n = names[lo], n + 1
                    files.create_dir(f"{root}/{key}={at}")
                    out = files.open_output_stream(f"{root}/{key}={at}/.{attempt}")
                    out.write(f"{column}\n".encode())
                text = [x for x in b.column(1).slice(lo, hi - lo).to_pylist() if x is not None]
                out.write("".join(f"{x}\n" for x in text).encode())
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    home = spark._jvm.org.apache.hadoop.fs.Path(path)  # there even if no task has a row to write
    home.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(home)
    return lines.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def memoized(spark: SparkSession, directory: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the table stored under ``key``, or build and store it first.

    The key should be a hash of the whole spec and input (``spec_key``); a table counts as stored only
    once its write has been committed.
    """
    path = f"{directory.rstrip('/')}/{key}.parquet"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_summary(rows: DataFrame, path: str) -> None:
    """Append run summaries; they carry a run time, so that readers can put the newest first."""
    if "run_at" not in rows.columns:
        rows = rows.withColumn("run_at", F.current_timestamp())
    rows.write.mode("append").parquet(path)


def read_summary(spark: SparkSession, path: str, newest_first: bool = True) -> DataFrame:
    """All runs; a column that some runs lack is NULL there."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    return df.orderBy(F.col("run_at").desc() if newest_first else F.col("run_at"))


def write_submission(df: DataFrame, path: str, one_file: bool = False) -> None:
    """``seg_id, time_to_failure`` as CSV with header, in ranges of sorted segments; merged into one file on request."""
    rows = df.select("seg_id", "time_to_failure")
    rows = rows.coalesce(1).sortWithinPartitions("seg_id") if one_file else rows.orderBy("seg_id")
    rows.write.mode("overwrite").csv(path, header=True)


def append_predictions(predictions: DataFrame, path: str, run: str) -> None:
    """Out-of-fold predictions ``fold, pos, y, prediction`` of a run, as rows ``run, fold, pos, y, yhat`` of one table."""
    rows = predictions.select(F.lit(run).alias("run"), F.col("fold").cast("int").alias("fold"), "pos", "y", F.col("prediction").alias("yhat"))
    rows.write.mode("append").partitionBy("run").parquet(path)


def read_predictions(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    df = spark.read.schema("fold int, pos bigint, y double, yhat double, run string").parquet(path).select("run", "fold", "pos", "y", "yhat")
    return df if run is None else df.filter(F.col("run") == run)


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """Out-of-fold predictions by row: where folds overlap, the last fold wins."""
    return predictions.groupBy("pos").agg(F.max_by("y", "fold").alias("y"), F.max_by("yhat", "fold").alias("yhat"))
