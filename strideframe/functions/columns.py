"""Small scalar and array expressions, and column selection by name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..series import dense_positions
from ..tables import written

NOT_A_METRIC = r"(?:fold|model|data|preproc)"


def metric_columns(df: DataFrame, pattern: str = NOT_A_METRIC) -> list[str]:
    return [c for c in df.columns if not re.match(pattern, c)]


def detail_columns(df: DataFrame, pattern: str = NOT_A_METRIC) -> list[str]:
    return [c for c in df.columns if re.match(pattern, c)]


def by_mask(columns: list[str], mask: list[bool], invert: bool = False) -> list[str]:
    return [c for c, keep in zip(columns, mask, strict=True) if bool(keep) != invert]


def segment_id(file_name: Column) -> Column:
    return F.split(file_name, r"\.")[0]


def truncate_name(name: Column, size: int = 250) -> Column:
    return F.when(name == "", name).otherwise(F.concat(F.substring(name, 1, size), F.lit("..")))


def join_details(*columns: Column) -> Column:
    """Non-null descriptors, each followed by a newline."""
    text = F.concat_ws("\n", *columns)
    return F.when(text == "", text).otherwise(F.concat(text, F.lit("\n")))


def array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def parse_list(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def parse_map(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def list_statistics(df: DataFrame, column: str) -> DataFrame:
    """Add ``_mean, _min, _max, _std`` of a score list; missing scores, and those a shorter list lacks, count as 0.

    The standard deviation is the sample one.
    """
    longest = df.select(F.max(F.size(column)).alias("m")).scalar()
    padded = F.concat(F.transform(column, lambda v: F.coalesce(v, F.lit(0.0))),
                      F.array_repeat(F.lit(0.0), F.col("_m") - F.size(column)))
    df = df.withColumn("_m", longest).withColumn("_a", padded)
    mean = array_mean(F.col("_a"))
    spread = F.aggregate("_a", F.lit(0.0), lambda s, v: s + (v - F.col("_mean")) * (v - F.col("_mean")))
    std = F.when(F.col("_m") > 1, F.sqrt(spread / (F.col("_m") - 1)))
    return (df.withColumn("_mean", mean)
            .select(*[c for c in df.columns if c not in ("_m", "_a")], F.col("_mean").alias(f"{column}_mean"),
                    F.array_min("_a").alias(f"{column}_min"), F.array_max("_a").alias(f"{column}_max"), std.alias(f"{column}_std")))


def score_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, <value>_mean, _min, _max, _std``: the same statistics of scores in rows, one list per key group.

    Partial aggregates: no list is ever collected, and the zeros that a shorter list lacks to the longest one enter in closed form.
    """
    v = F.coalesce(F.col(value), F.lit(0.0))
    own = written(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(v).alias("_own"), F.var_pop(v).alias("_var"), F.min(v).alias("_min"), F.max(v).alias("_max")), "scores")
    n, longest = F.col("_n"), own.select(F.max("_n").alias("m")).scalar()
    own = own.withColumn("_m", longest).withColumn("_mean", F.col("_own") * n / F.col("_m"))
    lacks = n < F.col("_m")
    squares = n * F.col("_var") + n * F.pow(F.col("_own") - F.col("_mean"), 2) + (F.col("_m") - n) * F.pow("_mean", 2)
    with_zero = lambda pick, c: F.when(lacks, pick(F.col(c), F.lit(0.0))).otherwise(F.col(c))
    return own.select(*keys, F.col("_mean").alias(f"{value}_mean"), with_zero(F.least, "_min").alias(f"{value}_min"), with_zero(F.greatest, "_max").alias(f"{value}_max"),
                      F.when(F.col("_m") > 1, F.sqrt(squares / (F.col("_m") - 1))).alias(f"{value}_std"))


def transpose_scores(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``df`` with ``position``: the k-th rows of all lists have position k, so that grouping by it is the transposed table.

    In rows, whatever the length of a list; an entry that a shorter list lacks has no row (it counts as 0).
    """
    return dense_positions(df, keys, order, "position")


def best_runs(summary: DataFrame, metric: str = "mean_squared_error") -> DataFrame:
    """Run summaries with the statistics of a metric, smallest mean first."""
    return list_statistics(summary, metric).orderBy(f"{metric}_mean")


def transpose_lists(df: DataFrame, column: str, order: str) -> DataFrame:
    """``position, values``: the k-th entries of all lists together, in ``order`` (missing ones as 0)."""
    longest = df.select(F.max(F.size(column)).alias("m")).scalar()
    cells = (df.withColumn("_m", longest).filter("_m > 0")
             .select(F.col(order).alias("_o"), F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("position"), column)
             .select("_o", "position", F.coalesce(F.get(column, F.col("position")), F.lit(0.0)).alias("v")))
    values = F.array_sort(F.collect_list(F.struct("_o", "v")))
    return cells.groupBy("position").agg(F.transform(values, lambda e: e["v"]).alias("values"))


def trend_overlay(df: DataFrame, order: str, prediction: str, slope: float) -> DataFrame:
    """Predictions replaced by a line of the given slope (best intercept), not below 0."""
    intercept = df.select(F.avg(F.col(prediction) - slope * F.col(order)).alias("b")).scalar()
    return df.withColumn("trend", F.greatest(F.lit(slope) * F.col(order) + intercept, F.lit(0.0)))


def ramp(pos: Column, n: Column | int, inverted: bool = False) -> Column:
    """0 .. 1 over n rows, or 1 .. 0."""
    up = pos / (n - 1)
    return 1 - up if inverted else up


def timestamp_label(ts: Column | None = None) -> Column:
    return F.date_format(ts if ts is not None else F.current_timestamp(), "'date'dd_MM_'time'HH_mm_ss")
