"""Row ranges of a series by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.folds import mix
from ..series import KEY, join_small, lengths


def row_range(s: DataFrame, begin: int, end: int) -> DataFrame:
    """Rows begin .. end-1 of each series (reaches the scan as a filter on ``pos``)."""
    return s.filter((F.col("pos") >= begin) & (F.col("pos") < end))


def leading_share(s: DataFrame, denominator: int = 10) -> DataFrame:
    """The first n // denominator rows of each series."""
    return join_small(s, lengths(s), [KEY]).filter(F.col("pos") < F.floor(F.col("n") / denominator)).drop("n")


def three_slices(s: DataFrame, size: int) -> DataFrame:
    """The first, middle and last ``size`` rows, labelled ``part``; overlapping slices repeat rows."""
    n = F.col("n")
    middle = lambda k: F.floor((n + k * size) / 2)
    spans = F.array(
        F.struct(F.lit("first").alias("part"), F.lit(0).cast("bigint").alias("a"), F.lit(size).cast("bigint").alias("b")),
        F.struct(F.lit("middle").alias("part"), middle(-1).alias("a"), middle(1).alias("b")),
        F.struct(F.lit("last").alias("part"), (n - size).alias("a"), n.alias("b")))
    rows = join_small(s, lengths(s), [KEY]).withColumn("_span", F.explode(F.filter(
        spans, lambda p: (F.col("pos") >= p["a"]) & (F.col("pos") < p["b"]))))
    return rows.withColumn("part", F.col("_span.part")).drop("_span", "n")


def random_slice(s: DataFrame, n: int, size: int, seed: int) -> DataFrame:
    """``size`` contiguous rows from a seeded random start in 0 .. n-size, ``n`` being the length of the series."""
    begin = F.pmod(mix(F.lit(0), seed), F.lit(n - size + 1))
    return row_range(s, begin, begin + size)
