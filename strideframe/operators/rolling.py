"""Row-preserving operators: one output row per input row.

Moving sums are differences of running sums inside a halo block.  A running sum is O(1) per row,
while a sliding ``rowsBetween`` frame re-aggregates its whole buffer for every row, which is too
slow for windows of 1,000 to 100,000 rows.  Moments are not differences, but merged from the moments of
two parts, so that nothing cancels, whatever the level of the series.

Missing values (NULL) are left out of moving means, deviations and clipping bounds; where no value is
left, the result is NULL.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import BLOCK_KEYS, Frame, block_size, halo, idiv
from ..series import KEY, join_small
from ..tables import written
from .quantiles import exact_quantiles

TINY = 2.2250738585072014e-308  # smallest normal double


@dataclass(frozen=True)
class RowOp:
    """``left``/``right``: rows of context on each side; ``apply`` rewrites ``x`` of a frame.

    ``own_block`` asks for a frame of that block size, not shared with other operators.
    """

    left: int
    right: int
    apply: Callable[[Frame], Frame]
    own_block: int | None = None


def moving_sums(f: Frame, terms: dict[str, tuple[str, int, int]]) -> Frame:
    """Add columns ``{out: (column, before, after)}``: the sum of a column over rows pos-before .. pos+after.

    Each is the difference of two growing frames (up to pos+after, up to pos-before-1), which Spark
    evaluates incrementally, and all of them share one pass over the block.
    """
    start = Window.unboundedPreceding
    upto = lambda c, end: F.coalesce(F.sum(c).over(f.ordered.rowsBetween(start, end)), F.lit(0.0))
    return f.with_df(f.df.select("*", *[(upto(c, after) - upto(c, -before - 1)).alias(out)
                                        for out, (c, before, after) in terms.items()]))


def _with_x(f: Frame, x: Column) -> Frame:
    scratch = [c for c in f.df.columns if c.startswith("_")]
    return f.with_df(f.df.withColumn("x", x).drop(*scratch))


def trailing_moments(f: Frame, window: int) -> Frame:
    """Add ``_n, _mean, _m2``: number, mean and central square sum of the values in the last ``window`` rows.

    The block is cut into stretches of ``window`` rows.  The last ``window`` rows are the head of the row's own stretch up to
    the row, and the end of the stretch before: two growing frames, one from each side, whose moments are merged.
    """
    df = f.df.withColumn("_cut", idiv("pos", window))
    stretch = Window.partitionBy(*BLOCK_KEYS, "_cut")
    for side, order in (("h", F.col("pos").asc()), ("t", F.col("pos").desc())):
        grown = stretch.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        n = F.count("x").over(grown)
        df = df.withColumn(f"_{side}n", n).withColumn(f"_{side}a", F.avg("x").over(grown)).withColumn(f"_{side}q", F.var_pop("x").over(grown) * n)
    # a row before which there are fewer lies in the first stretch
    other = F.lit(None) if window == 1 else F.lag(F.struct("_cut", "_tn", "_ta", "_tq"), window - 1).over(f.ordered)
    df = df.withColumn("_b", other.cast("struct<_cut: bigint, _tn: bigint, _ta: double, _tq: double>"))
    other = F.when(F.col("_b._cut") != F.col("_cut"), F.col("_b"))
    n2, a2, q2 = F.coalesce(other["_tn"], F.lit(0)), other["_ta"], other["_tq"]
    n = F.col("_hn") + n2
    both = (F.col("_hn") > 0) & (n2 > 0)
    gap = F.col("_ha") - a2
    mean = F.when(both, a2 + gap * F.col("_hn") / n).otherwise(F.coalesce("_ha", a2))
    m2 = F.when(both, F.col("_hq") + q2 + gap * gap * F.col("_hn") * n2 / n).otherwise(F.coalesce("_hq", q2))
    return f.with_df(df.select(*f.df.columns, n.alias("_n"), mean.alias("_mean"), m2.alias("_m2")))


def r_mean(window_size: int = 100) -> RowOp:
    """Trailing moving mean; the first rows average what there is."""

    def apply(f: Frame) -> Frame:
        df = f.df.withColumn("_c", F.avg("x").over(f.whole)).withColumn("_d", F.col("x") - F.col("_c"))
        df = df.withColumn("_one", F.col("x").isNotNull().cast("double"))
        f = moving_sums(f.with_df(df), {"_s": ("_d", window_size - 1, 0), "_n": ("_one", window_size - 1, 0)})
        return _with_x(f, F.when(F.col("_n") > 0, F.col("_c") + F.col("_s") / F.col("_n")))

    return RowOp(window_size - 1, 0, apply)


def r_std(window_size: int = 100) -> RowOp:
    """Trailing moving population standard deviation; exactly 0 on the first row and on constant stretches."""

    def apply(f: Frame) -> Frame:
        return _with_x(trailing_moments(f, window_size), F.when(F.col("_n") > 0, F.sqrt(F.col("_m2") / F.col("_n"))))

    return RowOp(window_size - 1, 0, apply)


def r_sta_lta(sta_window: int = 1000, lta_window: int = 10000) -> RowOp:
    """Short-term over long-term mean of squares; early rows still divide by the full window lengths.  A missing value adds nothing."""
    if sta_window > lta_window:
        raise ValueError("the short-term window cannot be longer than the long-term window")

    def apply(f: Frame) -> Frame:
        df = f.df.withColumn("_sq", F.col("x") * F.col("x"))
        f = moving_sums(f.with_df(df), {"_sta": ("_sq", sta_window - 1, 0), "_lta": ("_sq", lta_window - 1, 0)})
        sta = F.when(F.col("pos") < lta_window - 1, 0.0).otherwise(F.col("_sta") / sta_window)
        return _with_x(f, sta / F.greatest(F.col("_lta") / lta_window, F.lit(TINY)))

    return RowOp(lta_window - 1, 0, apply)


def r_savgol_filter(window_length: int = 101, polyorder: int = 1) -> RowOp:
    """Savitzky-Golay smoothing with polynomial ends, for polynomials up to order 3.

    The least-squares polynomial over a centred window depends on x only through the moments
    sum(k^p x), k = -h..h, and those are differences of running sums.  The rows nearer than h to an
    end of the series are read off the polynomial of the first / last full window (the fit to the
    first / last ``window_length`` rows), which is at most h rows away, so that the ends need no
    pass of their own.  A row is NULL where the window it is read off lacks a value.  Higher orders get blocks of a few windows, to keep the powers of the
    block-local coordinate small.
    """
    if window_length % 2 == 0:
        raise ValueError(f"window_length must be a positive odd integer, not {window_length}")
    if not 0 <= polyorder <= 3 or polyorder >= window_length:
        raise ValueError("polyorder must be 0, 1, 2 or 3, and less than window_length")
    h = window_length // 2
    degrees = range(polyorder + 1)
    m = {p: float(sum(k ** p for k in range(-h, h + 1))) for p in (0, 2, 4, 6)}

    def coefficients(s: list[Column]) -> list[Column]:
        """Polynomial from the moments s[p]; even and odd powers do not mix on a symmetric window."""
        even, odd = [s[0] / m[0]], [s[1] / m[2]] if polyorder >= 1 else []
        if polyorder >= 2:
            det = m[0] * m[4] - m[2] ** 2
            even = [(s[0] * m[4] - s[2] * m[2]) / det, (s[2] * m[0] - s[0] * m[2]) / det]
        if polyorder == 3:
            det = m[2] * m[6] - m[4] ** 2
            odd = [(s[1] * m[6] - s[3] * m[4]) / det, (s[3] * m[2] - s[1] * m[4]) / det]
        return [(even if p % 2 == 0 else odd)[p // 2] for p in degrees]

    def apply(f: Frame) -> Frame:
        origin = F.col("blk") * f.size + f.size // 2
        df = f.df.select("*", F.avg("x").over(f.whole).alias("_m"),
                         ((F.col("pos") - origin).cast("double") / window_length).alias("_u"), F.lit(1.0).alias("_one"), F.col("x").isNotNull().cast("double").alias("_there"))
        df = df.withColumn("_p0", F.col("x") - F.col("_m"))
        for p in degrees[1:]:
            df = df.withColumn(f"_p{p}", F.col(f"_p{p - 1}") * F.col("_u"))
        df = moving_sums(f.with_df(df), {**{f"_t{p}": (f"_p{p}", h, h) for p in degrees}, "_rows": ("_one", h, h), "_n": ("_there", h, h)}).df
        shifted = [sum((comb(p, i) * F.pow(-F.col("_u"), F.lit(float(p - i))) * F.col(f"_t{i}") for i in range(p + 1)),
                       F.lit(0.0)) * float(window_length) ** p for p in degrees]
        poly = F.struct(F.col("pos").alias("at"), *[c.alias(f"c{p}") for p, c in enumerate(coefficients(shifted))])
        df = df.withColumn("_fit", F.when(F.col("_n") == window_length, poly))
        df = df.withColumn("_near", F.coalesce(
            F.last("_fit", ignorenulls=True).over(f.so_far),
            F.first(F.when(F.col("blk") == 0, F.col("_fit")), ignorenulls=True).over(f.whole)))
        off = (F.col("pos") - F.col("_near.at")).cast("double")
        y = sum((F.col(f"_near.c{p}") * F.pow(off, F.lit(float(p))) for p in degrees), F.col("_m"))
        y = F.when((F.col("_n") == window_length) | ((F.col("_rows") < window_length) & (F.abs(off) <= h)), y)
        too_short = F.raise_error(F.lit(f"window_length {window_length} is greater than the series"))
        df = df.withColumn("_most", F.max("_rows").over(f.whole))
        return _with_x(f.with_df(df), F.when((F.col("blk") == 0) & (F.col("_most") < window_length), too_short).otherwise(y))

    return RowOp(2 * h, h, apply, own_block=16 * window_length if polyorder >= 2 else None)


ROW_OPS: dict[str, Callable[..., RowOp]] = {
    "r_mean": r_mean, "r_std": r_std, "r_sta_lta": r_sta_lta, "r_savgol_filter": r_savgol_filter,
}


def r_clip(s: DataFrame, q_low: float = 0.01, q_high: float = 0.99) -> DataFrame:
    """Clip each series to its own exact [q_low, q_high] quantiles (taken over the whole series).

    The series is read three times; in a chain it is written before (see ``rolled_frame``).
    """
    bounds = exact_quantiles(s, [KEY], "x", {"_lo": q_low, "_hi": q_high})
    return (join_small(s, bounds, [KEY])
            .withColumn("x", F.when(F.col("x").isNotNull(), F.least(F.greatest(F.col("x"), F.col("_lo")), F.col("_hi")))).drop("_lo", "_hi"))


def rolled_frame(s: DataFrame, ops: list[tuple[str, dict]], right: int = 0, left: int = 0, stride: int = 1,
                 block: int | None = None) -> Frame:
    """Run a chain of row operators, ending in a frame with ``left``/``right`` rows of context to spare.

    Consecutive moving operators share one frame: their halos add up, and one shuffle and one sort
    serve them all.  ``r_clip`` needs whole-series quantiles, so it closes the frame before it.
    """
    pending: list[RowOp] = []
    for name, params in ops:
        op = None if name == "r_clip" else ROW_OPS[name](**params)
        if pending and (op is None or op.own_block):
            s, pending = _run(s, pending, 0, 0, 1, block).core(), []
            if op is None:
                s = written(s, "signal")
        if op is None:
            s = r_clip(s, **params)
        elif op.own_block:
            s = _run(s, [op], 0, 0, 1, op.own_block).core()
        else:
            pending.append(op)
    return _run(s, pending, left, right, stride, block)


def _run(s: DataFrame, ops: list[RowOp], left: int, right: int, stride: int, block: int | None) -> Frame:
    left += sum(op.left for op in ops)
    right += sum(op.right for op in ops)
    f = halo(s, block_size(left + right, stride, block), left, right)
    for op in ops:
        f = op.apply(f)
    return f


def rolled(s: DataFrame, ops: list[tuple[str, dict]], block: int | None = None) -> DataFrame:
    """Row operators as a plain series table."""
    if not ops:
        return s
    *head, (name, params) = ops
    if name == "r_clip":
        return r_clip(written(rolled(s, head, block), "signal") if head else s, **params)
    op = ROW_OPS[name](**params)
    if op.own_block:
        return _run(rolled(s, head, block), [op], 0, 0, 1, op.own_block).core()
    return rolled_frame(s, ops, block=block).core()
