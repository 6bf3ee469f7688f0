"""Sliding-window features: one row per window, one column per feature."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import BLOCK_KEYS, MIN_BLOCK, Frame, block_size, halo
from ..series import KEY
from .kernels import KERNELS, OUTPUT_TYPES, block_features
from .panes import PANE_OPS, STATS, PaneOp, merge_panes, pane_aggregates, with_pane
from .rolling import rolled_frame


def is_window_op(name: str) -> bool:
    return name in PANE_OPS or name in KERNELS


def register_aggregate(name: str, build: Callable[..., PaneOp]) -> None:
    """Add an own feature that decomposes over panes: ``build(**params)`` returns its statistics and value."""
    PANE_OPS[name] = build


def register_kernel(name: str, output: str, fn: Callable) -> None:
    """Add an own feature of the ordered values: ``fn(windows, **params)`` returns one value (or array) per window.

    ``output`` is "double", "bigint" or "array<double>".
    """
    KERNELS[name] = (next(t for t, ddl in OUTPUT_TYPES.items() if ddl == output), fn)


def check_window(size: int, stride: int) -> None:
    for name, v in (("window_size", size), ("window_stride", stride)):
        if not isinstance(v, int) or isinstance(v, bool):
            raise TypeError(f"{name} must be an integer")
        if v < 1:
            raise ValueError(f"{name} must be positive")


def _valid(df: DataFrame, size: int, stride: int, short: str) -> DataFrame:
    """Keep the windows range(0, n - W + S, S): full ones, and the tail if it is longer than W - S rows.

    Whether a window counts can be told from its own row count, so series lengths are not needed.
    """
    too_short = (F.col("win") == 0) & (F.col("n") < size)
    failure = (F.raise_error(F.concat(F.lit("series has fewer rows than the window: "), F.col(KEY)))
               if short == "error" else F.lit(False))
    return df.filter(F.when(too_short, failure.cast("boolean")).otherwise(F.col("n") > size - stride))


def window_features(s: DataFrame, features: dict[str, tuple[str, dict]], window_size: int, window_stride: int,
                    rows: list[tuple[str, dict]] = (), label: bool = False, short: str = "error",
                    block: int | None = None, keep_n: bool = False) -> DataFrame:
    """Compute ``{output: (window operator, params)}`` over the (optionally row-transformed) series.

    Output: ``series_id, win, <outputs>[, ttf]``.  ``label`` adds the last label of each window.
    ``short`` says what a series with fewer than ``window_size`` rows does: "error" or "drop".

    Features of the plain signal that need no neighbours are aggregated straight from the scan; all
    others share one halo frame (one shuffle), both the pane aggregates and the Arrow kernels.
    """
    check_window(window_size, window_stride)
    unknown = sorted({op for op, _ in features.values() if not is_window_op(op)})
    if unknown:
        raise KeyError(f"unknown window operators: {unknown}")
    if short not in ("error", "drop"):
        raise ValueError("short must be 'error' or 'drop'")
    panes = {k: PANE_OPS[op](**p) for k, (op, p) in features.items() if op in PANE_OPS}
    kernels = {k: (op, p) for k, (op, p) in features.items() if op in KERNELS}
    direct = {k: op for k, op in panes.items() if not (rows or op.leads or op.lags)}
    framed = {k: op for k, op in panes.items() if k not in direct}
    if label:
        direct["ttf"] = PaneOp({"n": STATS["n"], "ttf": STATS["ttf"]}, "ttf", defined=True)

    parts = []
    tail = max(0, window_size - window_stride)
    if framed or kernels:
        lead = max((lead for op in framed.values() for lead in op.leads), default=0)
        lag = max((op.lags for op in framed.values()), default=0)
        f = rolled_frame(s.select(KEY, "pos", "x"), list(rows), left=lag, right=tail + lead, stride=window_stride, block=block)
        if kernels:
            parts.append(block_features(f, kernels, window_size, window_stride, short))
        if framed:
            parts.append(_framed_panes(f, framed, window_size, window_stride, tail))
    if direct:
        df = with_pane(s, window_size, window_stride, list(direct.values()))
        df = df.groupBy(KEY, "pstart").agg(*pane_aggregates(list(direct.values())))
        size = block_size(tail, window_stride, block or max(MIN_BLOCK, 64 * window_stride))
        parts.append(merge_panes(halo(df, size, right=tail, pos="pstart"), direct, window_size, window_stride))
    out = assemble([_valid(p, window_size, window_stride, short) for p in parts], [KEY, "win", "n"])
    order = [KEY, "win", *(["n"] if keep_n else []), *features, *(["ttf"] if label else [])]
    return out.select(*order)


def assemble(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Put tables with the same key rows and different columns side by side.

    One union and one aggregate, so one exchange for any number of tables (a chain of joins needs two each).
    """
    if len(parts) == 1:
        return parts[0]
    columns = [c for p in parts for c in p.columns if c not in keys]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])


def _framed_panes(f: Frame, ops: dict[str, PaneOp], size: int, stride: int, tail: int) -> DataFrame:
    leads = sorted({lead for op in ops.values() for lead in op.leads})
    df = f.df.select("*", *[F.lead("x", lead).over(f.ordered).alias(f"x{lead}") for lead in leads])
    extra = {k: e for op in ops.values() for k, e in op.extra.items()}
    df = df.select("*", *[F.expr(sql).alias(k) for k, sql in extra.items()])
    start = F.col("blk") * f.size
    df = df.filter((F.col("pos") >= start) & (F.col("pos") < start + f.size + tail))
    df = with_pane(df, size, stride, list(ops.values())).groupBy(*BLOCK_KEYS, "pstart").agg(*pane_aggregates(list(ops.values())))
    return merge_panes(f.with_df(df), ops, size, stride)
