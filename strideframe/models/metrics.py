"""Regression metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _r2(y: Column, p: Column) -> Column:
    return 1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y))


METRICS = {
    "mean_absolute_error": lambda y, p: F.avg(F.abs(y - p)),
    "mean_squared_error": lambda y, p: F.avg((y - p) * (y - p)),
    "median_absolute_error": lambda y, p: F.median(F.abs(y - p)),
    "max_error": lambda y, p: F.max(F.abs(y - p)),
    "explained_variance_score": lambda y, p: 1 - F.var_pop(y - p) / F.var_pop(y),
    "r2_score": _r2,
}


def score(df: DataFrame, metrics: list[str], keys: list[str], y: str = "y", prediction: str = "prediction") -> DataFrame:
    """One row per key group, one column per metric."""
    unknown = [m for m in metrics if m not in METRICS]
    if unknown:
        raise KeyError(f"unknown metrics: {unknown}")
    return df.groupBy(*keys).agg(*[METRICS[m](F.col(y), F.col(prediction)).alias(m) for m in metrics])


def score_summary(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and population deviation of fold scores (over folds and repeats)."""
    return scores.agg(*[e for m in metrics for e in (F.avg(m).alias(m + "_mean"), F.stddev_pop(m).alias(m + "_std"))])
