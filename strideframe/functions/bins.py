"""Binning columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digitize(x: Column, low: float, step: float, edges: int) -> Column:
    """How many of the edges low, low + step, ... (``edges`` of them) are <= x: 0 .. edges.

    The quotient can be off by one next to an edge, so it is settled by comparing with the edges.
    """
    i = F.floor((x - low) / step)
    edge = lambda k: k * F.lit(float(step)) + F.lit(float(low))
    i = F.when(x < edge(i), i - 1).when(x >= edge(i + 1), i + 1).otherwise(i)
    # least and greatest skip NULL, so a missing value is kept missing by hand
    return F.when(x.isNotNull(), F.least(F.greatest(i + 1, F.lit(0)), F.lit(edges))).cast("bigint")


def label_class(x: Column, classes: int = 16) -> Column:
    """Unit bins of a label, as -1 .. classes-1."""
    return digitize(x, 0.0, 1.0, classes) - 1


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        x = F.greatest(x, F.lit(low))
    return x if high is None else F.least(x, F.lit(high))


def histogram(df: DataFrame, column: str, low: float, step: float, bins: int) -> DataFrame:
    """``bin, count`` of every bin, empty ones too; the last bin includes its right edge, values outside are left out."""
    x = F.col(column)
    b = digitize(x, low, step, bins + 1) - 1
    b = F.when(x == F.lit(float(bins)) * step + low, bins - 1).otherwise(b)
    counts = df.select(b.alias("bin")).filter((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    empty = df.sparkSession.range(bins).select(F.col("id").alias("bin"), F.lit(0).cast("bigint").alias("count"))
    return counts.unionByName(empty).groupBy("bin").agg(F.sum("count").alias("count"))
