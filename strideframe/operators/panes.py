"""Window features that decompose over panes, as two nested hash aggregates.

Windows start every S rows and are W rows long, so their edges fall on the residues 0 and W mod S.
Cutting the series there gives *panes* that every window contains whole or not at all.  Rows are
aggregated once per pane (partial aggregation runs before the shuffle), and each window then merges
its W/S panes: the work is n + (n/S)(W/S) instead of the n W/S of copying each row to its windows.

A feature of pairs (i, i + lag) sums over the rows start..end-lag only, which is a window that is
``lag`` rows shorter: one more cut, at (W - lag) mod S, makes it decompose too.

Missing values (NULL) are left out: statistics are those of the values that are there, features of
pairs or triples use those whose rows all have a value, and a window without any value has NULL.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import BLOCK_KEYS, Frame, idiv
from ..series import KEY

BLOCK = "(partition by spread, series_id, blk order by pos rows between {})"


@dataclass(frozen=True)
class Stat:
    """SQL aggregates over the rows of a pane, and over the panes of a window, by output name.

    ``merge`` sees the pane columns under their own names, ``off`` (pane start minus window start)
    and ``d`` (pane mean minus ``c``, a shift common to the panes of a block, so that squares do not
    cancel).  With ``lag``, panes that start in the last ``lag`` rows of the window do not take part.
    """

    pane: dict[str, str]
    merge: dict[str, str]
    lag: int = 0


@dataclass(frozen=True)
class PaneOp:
    """Statistics a feature needs, and its value over them (SQL; ``cnt`` is the number of values, ``span`` that of rows, as doubles).

    Where the window has no value, the feature is NULL, unless it is ``defined`` there too.

    ``leads`` asks for columns x1, x2, ... with later rows, ``lags`` for earlier rows in the frame,
    ``extra`` for further row columns.
    """

    stats: dict[str, Stat]
    value: str
    leads: tuple[int, ...] = ()
    lags: int = 0
    extra: dict[str, str] = field(default_factory=dict)
    defined: bool = False


def same(name: str, agg: str, order: str = "") -> Stat:
    """A statistic that merges by the same aggregate (``min`` of ``min``)."""
    pane, merge = (", pos", ", off") if order else ("", "")
    if name == "ttf":
        return Stat({name: f"{agg}(ttf{pane})"}, {name: f"{agg}(ttf{merge})"})
    return Stat({name: f"{agg}(x{pane}) {THERE}"}, {name: f"{agg}({name}{merge}) filter (where {name} is not null)"})


def extreme(name: str, agg: str, place: str) -> Stat:
    """The extreme value with its first or last position."""
    return Stat({name: f"{agg}(struct(x, {place} as p)) {THERE}"}, {name: f"{agg}({name}) filter (where {name} is not null)"})


def complete(name: str, expr: str, lag: int) -> dict[str, Stat]:
    """How many pairs (triples) have all their values."""
    return {name: Stat({name: f"count({expr})"}, {name: f"sum({name})"}, lag)}


THERE = "filter (where x is not null)"
CUBE = "coalesce(skew, 0D) * pow(m2, 1.5D) / sqrt(n)"  # third central power sum of a pane

STATS = {
    "n": Stat({"rows": "count(1)", "n": "count(x)"}, {"rows": "sum(rows)", "n": "sum(n)"}),
    "min": same("min", "min"),
    "max": same("max", "max"),
    "first": same("first", "min_by", "pos"),
    "last": same("last", "max_by", "pos"),
    "ttf": same("ttf", "max_by", "pos"),
    "energy": Stat({"energy": "sum(x * x)"}, {"energy": "sum(energy)"}),
    # power sums about c
    "m1": Stat({"mean": "avg(x)"}, {"a1": "sum(n * d)", "c": "first(c)"}),
    "m2": Stat({"m2": "var_pop(x) * count(x)"}, {"a2": "sum(m2 + n * d * d)"}),
    "m3": Stat({"skew": "skewness(x)"}, {"a3": f"sum({CUBE} + 3 * d * m2 + n * d * d * d)"}),
    "m4": Stat({"kurt": "kurtosis(x)"}, {"a4": "sum(coalesce(kurt + 3, 0D) * m2 * m2 / n "
                                               f"+ 4 * d * {CUBE} + 6 * d * d * m2 + n * d * d * d * d)"}),
    # co-moment of (position in the window, x about c), and the moments of the positions that have a value
    "trend": Stat({"cov": "covar_pop(x, double(pos - pstart)) * count(x)", "st": f"sum(pos - pstart) {THERE}",
                   "stt": f"sum(double(pos - pstart) * (pos - pstart)) {THERE}"},
                  {"tx": "sum(cov + d * (st + n * off))", "t1": "sum(st + n * off)", "t2": "sum(stt + 2 * off * st + double(n) * off * off)"}),
    # extremes, with their first or last position
    "firstmax": extreme("firstmax", "max", "-pos"),
    "lastmax": extreme("lastmax", "max", "pos"),
    "firstmin": extreme("firstmin", "min", "pos"),
    "lastmin": extreme("lastmin", "min", "-pos"),
}

# values over the merged statistics
DELTA = "(a1 / cnt)"
MEAN = f"(c + {DELTA})"
M2 = f"if(min = max, 0D, greatest(a2 - cnt * {DELTA} * {DELTA}, 0D))"
M3 = f"(a3 - 3 * {DELTA} * a2 + 2 * cnt * pow({DELTA}, 3))"
M4 = f"(a4 - 4 * {DELTA} * a3 + 6 * {DELTA} * {DELTA} * a2 - 3 * cnt * pow({DELTA}, 4))"
VARIANCE = f"({M2} / cnt)"
VAR = ("m1", "m2", "min", "max")


def num(v: float) -> str:
    return f"{float(v)!r}D"


def _op(value: str, *stats: str, leads=(), lags=0, extra=None, more: dict[str, Stat] | None = None) -> PaneOp:
    return PaneOp({"n": STATS["n"], **{s: STATS[s] for s in stats}, **(more or {})}, value, leads, lags, extra or {})


def _sum(name: str, expr: str, lag: int) -> dict[str, Stat]:
    return {name: Stat({name: f"sum({expr})"}, {name: f"sum({name})"}, lag)}


def _extreme(column: str, sign: int, shift: int) -> PaneOp:
    return _op(f"({sign} * {column}.p - win * stride + {shift}) / span", column)


def _difference(name: str, expr: str, value: str, *stats: str) -> PaneOp:
    return _op(value, *stats, leads=(1,), more={**_sum(name, expr, 1), **complete("pairs", "x1 - x", 1)})


def w_skewness() -> PaneOp:
    """Adjusted skewness; 0 for a constant window, undefined below 3 rows."""
    g1 = f"{M3} / cnt / pow({VARIANCE}, 1.5D)"
    return _op(f"case when cnt >= 3 then if({M2} = 0, 0D, sqrt(cnt * (cnt - 1)) / (cnt - 2) * {g1}) end", *VAR, "m3")


def w_kurtosis() -> PaneOp:
    """Adjusted excess kurtosis; 0 for a constant window, undefined below 4 rows."""
    g2 = f"(cnt * {M4} / ({M2} * {M2}) - 3)"
    adjusted = f"(cnt - 1) / ((cnt - 2) * (cnt - 3)) * ((cnt + 1) * {g2} + 6)"
    return _op(f"case when cnt >= 4 then if({M2} = 0, 0D, {adjusted}) end", *VAR, "m3", "m4")


def w_linear_trend() -> PaneOp:
    slope = "(tx - t1 / cnt * a1) / (t2 - t1 / cnt * t1)"
    return _op(f"case when cnt >= 2 then {slope} end", "m1", "trend")


def w_autocorrelation(lag: int = 10) -> PaneOp:
    """Undefined (NULL) where the variance is below 1e-8 or no pair exists."""
    y, t = ("x" if lag == 0 else f"x{lag}"), f"ac{lag}"
    products = Stat({f"{t}xy": f"sum((x - _rc) * ({y} - _rc))", f"{t}s": f"sum(x - _rc + {y} - _rc)"},
                    {f"{t}xy": f"sum({t}xy)", f"{t}s": f"sum({t}s)"}, lag)
    shift = Stat({"rc": "first(_rc)"}, {"rc": "first(rc)"})
    mu, pairs = f"({MEAN} - rc)", f"{t}n"
    r = f"({t}xy - {mu} * {t}s + {pairs} * {mu} * {mu}) / ({pairs} * {VARIANCE})"
    return _op(f"case when {pairs} > 0 and {VARIANCE} > 1e-8D then {r} end", *VAR, leads=(lag,) if lag else (),
               extra={"_rc": "avg(x) over " + BLOCK.format("unbounded preceding and unbounded following")},
               more={t: products, "rc": shift, **complete(pairs, f"x + {y}", lag)})


def _triple(name: str, lag: int, expr: Callable[[str, str], str]) -> PaneOp:
    """Mean over the rows that have two later rows at ``lag`` and ``2 lag``; 0 when none has."""
    y, z = (f"x{lag}", f"x{2 * lag}") if lag else ("x", "x")
    return _op(f"if(triples{lag} > 0, {name}{lag} / triples{lag}, 0D)", leads=(lag, 2 * lag) if lag else (),
               more={**_sum(f"{name}{lag}", expr(y, z), 2 * lag), **complete(f"triples{lag}", f"x + {y} + {z}", 2 * lag)})


def w_number_crossing_m(m: float = 0.1) -> PaneOp:
    name = "cross_" + str(float(m)).replace(".", "_").replace("-", "m").replace("+", "")
    return _op(f"bigint(coalesce({name}, 0))", leads=(1,),
               more=_sum(name, f"if((x > {num(m)}) <> (x1 > {num(m)}), 1, 0)", 1))


def w_pair_slope_trend() -> PaneOp:
    """(rises - non-rises) among the last 30 values, over 30."""
    step = "case when x1 > x then 1 when x1 <= x then -1 end"
    last30 = Stat({"slope30": "max_by(_slope, pos)"}, {"slope30": "max_by(slope30, off)"})
    return _op("if(span >= 30, slope30, coalesce(steps, 0)) / 30", leads=(1,), lags=30,
               extra={"_slope": f"sum({step}) over " + BLOCK.format("29 preceding and 1 preceding")},
               more={"slope30": last30, **_sum("steps", step, 1)})


def w_av_change_rate() -> PaneOp:
    """Mean index of the rows followed by a different value, or holding 0 (the name says otherwise)."""
    hit = "(x1 <> x or (x = 0 and x1 is not null))"
    stat = Stat({"hits": f"sum(if({hit}, 1, 0))", "hitpos": f"sum(if({hit}, pos - pstart, 0))"},
                {"hitpos": "sum(hitpos + hits * off)", "hits": "sum(hits)"}, 1)
    return _op("case when hits > 0 then hitpos / hits end", leads=(1,), more={"hits": stat})


PANE_OPS: dict[str, Callable[..., PaneOp]] = {
    "w_psd_sum": lambda fs=4e6: _op(f"{M2} / {num(fs)}", *VAR),  # Parseval: the bins add up to the centred energy
    "w_last_elem": lambda: _op("last", "last"),
    "w_min": lambda: _op("min", "min"),
    "w_max": lambda: _op("max", "max"),
    "w_mean": lambda: _op(MEAN, "m1"),
    "w_std": lambda: _op(f"sqrt({VARIANCE})", *VAR),
    "w_abs_energy": lambda: _op("energy", "energy"),
    "w_av_change_abs": lambda: _op("case when cnt > 1 then (last - first) / (cnt - 1) end", "first", "last"),
    "w_mean_change": lambda: _op("case when cnt > 1 then (last - first) / (cnt - 1) end", "first", "last"),
    "w_first_location_of_maximum": lambda: _extreme("firstmax", -1, 0),
    "w_last_location_of_maximum": lambda: _extreme("lastmax", 1, 1),
    "w_first_location_of_minimum": lambda: _extreme("firstmin", 1, 0),
    "w_last_location_of_minimum": lambda: _extreme("lastmin", -1, 1),
    "w_skewness": w_skewness,
    "w_kurtosis": w_kurtosis,
    "w_large_standard_deviation": lambda r=0.5: _op(f"sqrt({VARIANCE}) > {num(r)} * (max - min)", *VAR),
    "w_linear_trend": w_linear_trend,
    "w_av_change_rate": w_av_change_rate,
    "w_absolute_sum_of_changes": lambda: _difference("absd", "abs(x1 - x)", "coalesce(absd, 0D)"),
    "w_mean_abs_change": lambda: _difference("absd", "abs(x1 - x)", "case when pairs > 0 then absd / pairs end"),
    "w_eta_e": lambda: _difference("dd", "(x1 - x) * (x1 - x)",
                                   f"case when {M2} > 0 and pairs > 0 then dd / pairs / {VARIANCE} end", *VAR),
    "w_mean_second_derivative_central": lambda: _op(
        "case when bends > 0 then second / bends end", leads=(1, 2),
        more={**_sum("second", "(x2 - 2 * x1 + x) / 2", 2), **complete("bends", "x2 + x1 + x", 2)}),
    "w_autocorrelation": w_autocorrelation,
    "w_c3": lambda lag=100: _triple("c3_", lag, lambda y, z: f"x * {y} * {z}"),
    "w_time_reversal_asymmetry_statistic": lambda lag=100: _triple(
        "tras", lag, lambda y, z: f"{z} * {z} * {y} - {y} * x * x"),
    "w_number_crossing_m": w_number_crossing_m,
    "w_pair_slope_trend": w_pair_slope_trend,
}


def _pane_start(size: int, stride: int, lags: set[int]) -> Column:
    rem = F.pmod(F.col("pos"), F.lit(stride))
    cuts = sorted({(size - lag) % stride for lag in {0, *lags} if lag < size} - {0})
    inside = F.lit(0)
    for cut in cuts:
        inside = F.when(rem >= cut, cut).otherwise(inside)
    return F.col("pos") - rem + inside


def with_pane(df: DataFrame, size: int, stride: int, ops: list[PaneOp]) -> DataFrame:
    lags = {s.lag for op in ops for s in op.stats.values()}
    df = df.withColumn("pstart", _pane_start(size, stride, lags))
    # with gaps between windows, the rows in the gaps belong to none
    return df if stride <= size else df.filter(F.pmod(F.col("pos"), F.lit(stride)) < size)


def pane_aggregates(ops: list[PaneOp]) -> list[Column]:
    cols = {name: sql for op in ops for s in op.stats.values() for name, sql in s.pane.items()}
    return [F.expr(sql).alias(name) for name, sql in cols.items()]


def merge_panes(panes: Frame, ops: dict[str, PaneOp], size: int, stride: int) -> DataFrame:
    """Merge the panes of each window; all of it inside the block."""
    stats = {k: s for op in ops.values() for k, s in op.stats.items()}
    df = panes.df
    if "m1" in stats:
        df = df.withColumn("c", F.avg("mean").over(Window.partitionBy(*BLOCK_KEYS))).withColumn("d", F.col("mean") - F.col("c"))
    first = F.col("blk") * (panes.size // stride)
    lo = F.greatest(first, F.when(F.col("pstart") >= size, idiv(F.col("pstart") - size, stride) + 1).otherwise(0))
    hi = F.least(first + (panes.size // stride - 1), idiv("pstart", stride))
    df = (df.withColumn("_lo", lo).withColumn("_hi", hi).filter("_lo <= _hi")
          .withColumn("win", F.explode(F.sequence("_lo", "_hi")))
          .withColumn("off", F.col("pstart") - F.col("win") * stride))
    guard = {name: s.lag for s in stats.values() if s.lag for name in s.pane}
    df = df.select(*[F.when(F.col("off") < size - guard[k], F.col(k)).alias(k) if k in guard else k for k in df.columns])
    merged = {name: sql for s in stats.values() for name, sql in s.merge.items()}
    df = df.groupBy(*BLOCK_KEYS, "win").agg(*[F.expr(sql).alias(name) for name, sql in merged.items()])
    df = df.withColumn("stride", F.lit(stride)).withColumn("cnt", F.col("n").cast("double")).withColumn("span", F.col("rows").cast("double"))
    value = lambda op: op.value if op.defined else f"case when n > 0 then {op.value} end"
    return df.select(KEY, "win", F.col("rows").alias("n"), *[F.expr(value(op)).alias(name) for name, op in ops.items()])
