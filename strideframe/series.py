"""Series tables: building them from other tables, and checking their contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

KEY = "series_id"


def series(df: DataFrame, pos: str | Column, x: str | Column, series_id: str | Column | None = None,
           label: str | Column | None = None) -> DataFrame:
    """Project any table that already has a dense position onto the series layout.

    Small integer signals are widened to double here, before any square can overflow.
    NaN becomes NULL, so that Spark aggregates skip it.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    clean = lambda c: F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))
    sid = F.lit("main") if series_id is None else col(series_id).cast("string")
    cols = [sid.alias(KEY), col(pos).cast("bigint").alias("pos"), clean(x).alias("x")]
    if label is not None:
        cols.append(clean(label).alias("ttf"))
    return df.select(*cols)


def dense_positions(df: DataFrame, keys: list[str], order: str, out: str = "pos") -> DataFrame:
    """Number the rows of each key group 0, 1, ... in ``order``, without sorting a whole group in one task.

    Rows are dealt by ranges of (keys, order) of about equal size, sorted there and written with a running number.  A group's
    rows in one range are numbered without gaps, so its position is that number plus what the group has in earlier ranges: a running
    sum over a row per (group, range), at most one per range more than there are groups.  A group may thus hold any share of the rows, in a
    burst or not, as long as ``order`` tells its rows apart.  The numbered table is written when this is called.
    """
    by = [*keys, order]
    rows = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_number", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("_range", F.shiftright("_number", 33))  # the range that a number was given in
    counts = rows.groupBy(*keys, "_range").agg(F.min("_number").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*keys, "_range", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return join_small(rows, shifts, [*keys, "_range"]).withColumn(out, F.col("_number") + F.col("_shift")).drop("_number", "_range", "_shift")


def contract_violations(s: DataFrame) -> DataFrame:
    """Series whose positions are not exactly 0..n-1 (one row per broken series; empty when all is well)."""
    stats = s.groupBy(KEY).agg(F.count(F.lit(1)).alias("rows"), F.min("pos").alias("first_pos"),
                               F.max("pos").alias("last_pos"), F.sum("pos").alias("_sum"))
    n = F.col("rows")
    dense = ((F.col("first_pos") == 0) & (F.col("last_pos") == n - 1)
             & (F.col("_sum").cast("decimal(38,0)") * 2 == n.cast("decimal(19,0)") * (n - 1).cast("decimal(19,0)")))
    return stats.filter(~dense).drop("_sum")


def lengths(s: DataFrame) -> DataFrame:
    """Rows per series (map-side combined; one row per series)."""
    return s.groupBy(KEY).agg((F.max("pos") + 1).alias("n"))


def join_small(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a table with one row per key to many rows.

    The planner cannot tell how large an aggregate will be, and would shuffle ``df`` by the keys, hot
    ones included.  So the table is written first: its bytes are then known, and Spark broadcasts it up to
    its own limit (``spark.sql.autoBroadcastJoinThreshold``); beyond that it is an ordinary join, with
    skew handling.
    """
    return df.join(written(table, "small"), keys, how)
