"""Scalers fitted on the training rows of every fold at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..series import join_small


def _statistics(df: DataFrame, keys: list[str], columns: list[str], shift, scale) -> DataFrame:
    aggs = [e for c in columns for e in (shift(c).alias("_a_" + c), scale(c).alias("_b_" + c))]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def _standard(c: str) -> tuple[Column, Column]:
    return F.avg(c), F.stddev_pop(c)


def _unit(c: str) -> tuple[Column, Column]:
    return F.min(c), F.max(c) - F.min(c)


SCALERS = {"StandardScaler": _standard, "MinMaxScaler": _unit}


def fit(df: DataFrame, columns: list[str], kind: str = "StandardScaler", keys: list[str] = ()) -> DataFrame:
    """One row of (shift, scale) per key; a constant column gets scale 1."""
    parts = SCALERS[kind]
    stats = _statistics(df, list(keys), columns, lambda c: parts(c)[0], lambda c: parts(c)[1])
    return stats.select(*keys, *["_a_" + c for c in columns],
                        *[F.when(F.col("_b_" + c) == 0, 1.0).otherwise(F.col("_b_" + c)).alias("_b_" + c) for c in columns])


def transform(df: DataFrame, columns: list[str], fitted: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(x - shift) / scale; the fitted table has one row per key (one in all without keys)."""
    if keys:
        joined = join_small(df, fitted, list(keys))
    else:
        joined = df.withColumns({c: fitted.select(c).scalar() for c in fitted.columns})
    scaled = {c: (F.col(c) - F.col("_a_" + c)) / F.col("_b_" + c) for c in columns}
    return joined.select(*[scaled[c].alias(c) if c in scaled else c for c in df.columns])


def scale_folds(folds: DataFrame, columns: list[str], kind: str = "StandardScaler") -> DataFrame:
    """Scale all rows of each fold by the statistics of its training rows."""
    fitted = fit(folds.filter(F.col("role") == "train"), columns, kind, ["fold"])
    return transform(folds, columns, fitted, ["fold"])
