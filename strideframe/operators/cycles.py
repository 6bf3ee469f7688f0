"""Splitting a labelled series into failure cycles, and putting chosen cycles together again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import MIN_BLOCK, block_size, halo, idiv
from ..series import KEY, join_small


def cycle_boundaries(s: DataFrame, threshold: float = 0.1, gap: int = 100_000) -> DataFrame:
    """``series_id, boundary``: 0, and the last position of every cluster of low labels.

    Two low labels belong to one cluster when they are at most ``gap`` rows apart, so a low label ends
    its cluster when the ``gap`` rows after it hold no other: a question for a halo frame of the low
    labels alone.  A series without any is an error.
    """
    ok = F.min("ttf") < threshold
    missing = F.raise_error(F.concat(F.lit("no label below the threshold in series "), F.col(KEY)))
    starts = s.groupBy(KEY).agg(F.coalesce(ok, F.lit(False)).alias("_ok"))
    starts = starts.filter(F.when(F.col("_ok"), True).otherwise(missing.cast("boolean")))
    low = halo(s.filter(F.col("ttf") < threshold).select(KEY, "pos"), block_size(gap), right=gap)
    ends = low.with_df(low.df.withColumn("_next", F.lead("pos").over(low.ordered))).core()
    ends = ends.filter(F.col("_next").isNull() | (F.col("_next") - F.col("pos") > gap))
    return starts.select(KEY, F.lit(0).cast("bigint").alias("boundary")).unionByName(ends.select(KEY, F.col("pos").alias("boundary")))


def cycle_ranges(boundaries: DataFrame) -> DataFrame:
    """``series_id, cycle_id, start, end``: half-open cycles between successive boundaries, numbered from 1."""
    order = Window.partitionBy(KEY).orderBy("boundary")
    return (boundaries.select(KEY, F.row_number().over(order).alias("cycle_id"), F.col("boundary").alias("start"),
                              F.lead("boundary").over(order).alias("end"))
            .filter(F.col("end") > F.col("start")))


def in_ranges(df: DataFrame, ranges: DataFrame, keys: list[str], columns: list[str], pos: str = "pos", block: int = MIN_BLOCK,
              how: str = "inner") -> DataFrame:
    """Interval join: rows whose position lies in ``[start, end)`` of a range with the same keys.

    Each range is listed under the blocks it touches, which turns the interval condition into an
    equi-join that spreads over (keys, block).
    """
    touched = F.sequence(idiv("start", block), idiv(F.col("end") - 1, block))
    listed = ranges.filter("end > start").select(*keys, *columns, F.col("start").alias("_start"), F.col("end").alias("_end"),
                                                 F.explode(touched).alias("_blk"))
    df = df.withColumn("_blk", idiv(pos, block))
    on = [F.col("l." + k) == F.col("r." + k) for k in [*keys, "_blk"]]
    on += [F.col("l." + pos) >= F.col("r._start"), F.col("l." + pos) < F.col("r._end")]
    joined = df.alias("l").join(listed.alias("r"), on, how)
    return joined.select(*[F.col("l." + c) for c in df.columns if c != "_blk"], *[F.col("r." + c) for c in columns])


def split_cycles(s: DataFrame, threshold: float = 0.1, gap: int = 100_000) -> DataFrame:
    """Series rows with their ``cycle_id``; rows from the last boundary on are dropped."""
    ranges = cycle_ranges(cycle_boundaries(s, threshold, gap))
    return in_ranges(s, ranges, [KEY], ["cycle_id"])


def combine_cycles(cycles: DataFrame, exclude: list[int] = ()) -> DataFrame:
    """Leave some cycles out and renumber the positions of the rest 0, 1, ... in cycle order."""
    kept = cycles.filter(~F.col("cycle_id").isin(list(exclude))) if exclude else cycles
    sizes = kept.groupBy(KEY, "cycle_id").agg(F.min("pos").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(KEY).orderBy("cycle_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(KEY, "cycle_id", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_shift"))
    return join_small(kept, sizes, [KEY, "cycle_id"]).withColumn("pos", F.col("pos") + F.col("_shift")).drop("_shift")
