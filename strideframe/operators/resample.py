"""Linear interpolation of feature tables to another number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..series import KEY, join_small


def _interpolate(targets: DataFrame, df: DataFrame, columns: list[str], at: str) -> DataFrame:
    """``targets(series_id, <at>, n_old, n_new)``: evaluate each column at position at*(n_old-1)/(n_new-1).

    Both neighbours of a target come from one equi-join on (series, position), which no key can skew.
    """
    step = F.when(F.col("n_new") > 1, (F.col("n_old") - 1) / (F.col("n_new") - 1)).otherwise(0.0)
    t = F.least(F.col(at) * step, (F.col("n_old") - 1).cast("double"))
    lo = F.floor(t)
    near = F.array(F.struct(lo.alias("p"), (1 - (t - lo)).alias("w")), F.struct((lo + 1).alias("p"), (t - lo).alias("w")))
    near = targets.select(KEY, at, F.explode(near).alias("e")).filter("e.w > 0").select(KEY, at, F.col("e.p").alias("_p"), F.col("e.w").alias("_w"))
    hits = near.join(df.withColumnRenamed("win", "_p"), [KEY, "_p"])

    def value(c: str) -> Column:
        # a missing neighbour makes the value missing
        return F.when(F.count(c) == F.count(F.lit(1)), F.sum(F.col(c) * F.col("_w"))).alias(c)

    return hits.groupBy(KEY, at).agg(*[value(c) for c in columns])


def resample_to(df: DataFrame, columns: list[str], grid: DataFrame) -> DataFrame:
    """Bring ``df(series_id, win, columns)`` to the rows of ``grid(series_id, win)``, series by series."""
    old = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_old"))
    new = grid.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_new"))
    targets = join_small(grid, old.join(new, KEY), [KEY])
    return _interpolate(targets, df, columns, "win")


CHUNK = 1 << 16


def counter(df: DataFrame, rows: Column, out: str) -> DataFrame:
    """Repeat each row with ``out`` = 0 .. rows-1; in two steps, so that no single task expands a long range."""
    last = rows - 1
    df = df.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(CHUNK).cast("bigint"))))
    df = df.repartition(*df.columns)
    return df.withColumn(out, F.explode(F.sequence("_c", F.least(F.col("_c") + (CHUNK - 1), last)))).drop("_c")


def resample(df: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """Bring every series of ``df(series_id, win, columns)`` to ``rows`` rows."""
    old = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_old")).withColumn("n_new", F.lit(rows).cast("bigint"))
    return _interpolate(counter(old, F.col("n_new"), "win"), df, columns, "win")
