"""Halo frames: ordered work on long series without one task per series.

A series is cut into blocks of ``size`` rows.  Each block also receives the ``left`` rows before
it and the ``right`` rows after it, so that moving frames, leads and sliding windows that belong
to the block can be evaluated inside its block alone.  This costs one shuffle of
``(size + left + right) / size`` times the rows, and everything that follows on the same keys
(window functions, pane aggregates, grouped Arrow functions) needs no further exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import KEY

MIN_BLOCK = 1 << 16

# Blocks are clustered by a hash of (series, block).  Where all rows belong to one series, the optimizer
# drops the constant series from every grouping, and a clustering by (series, block) would not be
# recognised as one by block; a clustering by the hash always is.
SPREAD = "spread"
BLOCK_KEYS = [SPREAD, KEY, "blk"]


def idiv(a, b: int):
    """Integer division of a non-negative BIGINT column by a positive constant (stays in integer arithmetic)."""
    return F.call_function("div", F.col(a) if isinstance(a, str) else a, F.lit(b))


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    size: int

    @property
    def ordered(self):
        return Window.partitionBy(*BLOCK_KEYS).orderBy("pos")

    @property
    def so_far(self):
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def whole(self):
        """The whole block; ordered like the others, so that one sort serves all."""
        return self.ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def with_df(self, df: DataFrame) -> "Frame":
        return Frame(df, self.size)

    def core(self) -> DataFrame:
        """The rows a block owns, each exactly once."""
        start = F.col("blk") * self.size
        return self.df.filter((F.col("pos") >= start) & (F.col("pos") < start + self.size)).drop(SPREAD, "blk")


def per_block(df: DataFrame, evaluate, schema: str) -> DataFrame:
    """Run ``evaluate(key, positions, values) -> pyarrow.Table`` on each block of a frame's rows.

    The rows of a block are packed into two arrays on the JVM side first, which crosses to Python
    at twice the speed of single rows.  They come in no particular order.
    """
    missing = F.lit(float("nan"))  # collect_list would skip NULL
    packed = df.groupBy(*BLOCK_KEYS).agg(F.collect_list("pos").alias("pos"), F.collect_list(F.coalesce("x", missing)).alias("x"))

    def unpack(key, table):
        return evaluate(tuple(k.as_py() for k in key[1:]), *(table[c].combine_chunks().flatten().to_numpy() for c in ("pos", "x")))

    return packed.groupBy(*BLOCK_KEYS).applyInArrow(unpack, schema)


def block_size(halo: int, stride: int = 1, minimum: int | None = None) -> int:
    """A block at least four times the halo (so at most 1.25x rows are shuffled), a multiple of ``stride``."""
    want = max(4 * halo, minimum or MIN_BLOCK)
    return -(-want // stride) * stride


def halo(s: DataFrame, size: int, left: int = 0, right: int = 0, pos: str = "pos") -> Frame:
    """Copy each row to every block that needs it, and cluster the copies by block."""
    lo = idiv(F.greatest(F.col(pos) - right, F.lit(0)), size)
    hi = idiv(F.col(pos) + left, size)
    df = s.withColumn("blk", F.explode(F.sequence(lo, hi)) if left or right else idiv(pos, size))
    return Frame(df.withColumn(SPREAD, F.xxhash64(KEY, "blk")).repartition(SPREAD), size)
