"""The driver tables as series: ``events`` is one long ordered signal, and also one short signal per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import idiv
from ..series import dense_positions, series

LABEL_BLOCK = 1 << 20
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"  # ts carries no time zone


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_series(spark: SparkSession, sf_dir: str, label: bool = False) -> DataFrame:
    """``events`` in event order; the label is the number of seconds to the next ``error`` event (NULL after the last).

    The next error is looked up in two levels: inside blocks of rows, and over the first error of each
    later block, so that no window spans the table.
    """
    ev = read_table(spark, sf_dir, "events")
    if not label:
        return series(ev, "event_id", "value")
    ev = ev.select("event_id", "value", F.expr(MICROS).alias("t"), (F.col("event_type") == "error").alias("failed"))
    ev = ev.withColumn("_b", idiv("event_id", LABEL_BLOCK))
    failure = F.when(F.col("failed"), F.col("t"))
    per_block = ev.groupBy("_b").agg(F.min(failure).alias("_first"))
    later = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.select("_b", F.min("_first").over(later).alias("_later"))
    onwards = Window.partitionBy("_b").orderBy(F.col("event_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("_own", F.min(failure).over(onwards)).join(per_block, "_b")
    ttf = (F.coalesce("_own", "_later") - F.col("t")) / F.lit(1e6)
    return series(ev.withColumn("_ttf", ttf), "event_id", "value", label="_ttf")


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per user, in time order; events of one time are in the order of their ids."""
    ev = read_table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "value")
    return series(dense_positions(ev, ["user_id"], "at"), "pos", "value", "user_id")
