"""Window features over the whole event signal, one query per operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators.kernels import KERNELS
from strideframe.operators.panes import PANE_OPS, PaneOp
from strideframe.operators.panes import STATS as STATS_OF
from strideframe.operators.windows import register_aggregate, register_kernel, window_features
from strideframe.sources.tables import event_series, user_series

from . import query
from .rows import USERS

W, S = 500, 100


def windows_cte(w: int = W, s: int = S, source: str = "SELECT event_id AS pos, value AS x FROM events") -> str:
    """``r(win, i, n, x)``: the rows of every window, i = 0..n-1, partial tail included."""
    return f"""e AS ({source}), m AS (SELECT max(pos) + 1 AS total FROM e),
k AS (SELECT unnest(range(CAST(ceil((total - {w} + {s}) / {s}.0) AS BIGINT))) AS win, total FROM m),
r AS (SELECT win, pos - win * {s} AS i, least({w}, total - win * {s}) AS n, x
      FROM k JOIN e ON pos >= win * {s} AND pos < win * {s} + {w})"""


def by_window(expr: str, ctes: str = "", rows: str = "r", w: int = W, s: int = S) -> str:
    return f"WITH {windows_cte(w, s)}{ctes} SELECT win, {expr} AS y FROM {rows} GROUP BY win"


def window_query(name: str, op: str, params: dict, sql: str | None, digits: int | None = 6, w: int = W, s: int = S, rows=()):
    def run(spark, sf):
        df = window_features(event_series(spark, sf), {"y": (op, params)}, w, s, rows=list(rows), short="error" if w <= W else "drop")
        return df.select("win", "y") if digits is None else df.select("win", F.round("y", digits).alias("y"))

    query(name, sql)(run)


def simple(op: str, expr: str, digits: int | None = 6, ctes: str = "", rows: str = "r", name: str | None = None, s: int = S, **params):
    expr = expr if digits is None else f"round({expr}, {digits})"
    window_query(name or op, op, params, by_window(expr, ctes, rows, s=s), digits, s=s)


# one pass over the rows of a window
simple("w_min", "min(x)", None)
simple("w_max", "max(x)", None)
simple("w_mean", "avg(x)")
simple("w_std", "stddev_pop(x)")
simple("w_last_elem", "arg_max(x, i)", None)
simple("w_last_elem", "arg_max(x, i)", None, name="w_last_elem_partial_tail", s=300)
simple("w_std", "stddev_pop(x)", name="w_std_partial_tail", s=300)
simple("w_mean", "avg(x)", name="w_mean_gaps", s=700)
simple("w_abs_energy", "sum(x * x)", 4)
simple("w_psd_sum", "count(*) * var_pop(x) / 4e6", 8)
simple("w_av_change_abs", "(arg_max(x, i) - arg_min(x, i)) / (count(*) - 1)")
simple("w_mean_change", "(arg_max(x, i) - arg_min(x, i)) / (count(*) - 1)")
simple("w_first_location_of_maximum", "(arg_max(i, {'x': x, 'p': -i}))::DOUBLE / count(*)")
simple("w_last_location_of_maximum", "(arg_max(i, {'x': x, 'p': i}) + 1)::DOUBLE / count(*)")
simple("w_first_location_of_minimum", "(arg_min(i, {'x': x, 'p': i}))::DOUBLE / count(*)")
simple("w_last_location_of_minimum", "(arg_min(i, {'x': x, 'p': -i}) + 1)::DOUBLE / count(*)")
simple("w_skewness", "skewness(x)")
simple("w_kurtosis", "kurtosis(x)", 5)
simple("w_large_standard_deviation", "stddev_pop(x) > 0.15 * (max(x) - min(x))", None, r=0.15)
simple("w_linear_trend", "regr_slope(x, i)", 8)

# order statistics
simple("w_quantile", "quantile_cont(x, 0.05)", q=0.05)
simple("w_median", "median(x)")
simple("w_irq", "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)")
simple("w_q31", "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)")

# neighbours inside the window
LEAD = """, l AS (SELECT *, lead(x) OVER t AS x1, lead(x, 2) OVER t AS x2, lead(x, 10) OVER t AS x10, lead(x, 20) OVER t AS x20
  FROM r WINDOW t AS (PARTITION BY win ORDER BY i))"""
simple("w_absolute_sum_of_changes", "sum(abs(x1 - x))", 4, LEAD, "l")
simple("w_mean_abs_change", "avg(abs(x1 - x))", 7, LEAD, "l")
simple("w_mean_second_derivative_central", "avg((x2 - 2 * x1 + x) / 2)", 8, LEAD, "l")
simple("w_av_change_rate", "avg(i) FILTER (x1 <> x OR (x = 0 AND x1 IS NOT NULL))", 6, LEAD, "l")
simple("w_number_crossing_m", "count(*) FILTER ((x > 40) <> (x1 > 40))", None, LEAD, "l", m=40)
simple("w_autocorrelation", """(sum(x * x10) - avg(x) * (sum(x) FILTER (x10 IS NOT NULL) + sum(x10)) + (count(*) - 10) * avg(x) * avg(x))
  / ((count(*) - 10) * var_pop(x))""", 6, LEAD, "l", lag=10)
simple("w_c3", "avg(x * x10 * x20)", 3, LEAD, "l", lag=10)
simple("w_time_reversal_asymmetry_statistic", "avg(x20 * x20 * x10 - x10 * x * x)", 3, LEAD, "l", lag=10)
simple("w_eta_e", "avg((x1 - x) * (x1 - x)) / var_pop(x)", 6, LEAD, "l")
simple("w_pair_slope_trend", "(count(*) FILTER (x1 > x AND i >= n - 30) - count(*) FILTER (x1 <= x AND i >= n - 30)) / 30.0::DOUBLE", 6, LEAD, "l")

# statistics of the window first, its rows second
STATS = """, g AS (SELECT win, avg(x) AS mu, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi, median(x) AS med,
  quantile_cont(x, 0.7) AS q70, quantile_cont(x, 0.03) AS q03, quantile_cont(x, 0.97) AS q97 FROM r GROUP BY win),
z AS (SELECT r.*, mu, sd, lo, hi, med, q70, q03, q97 FROM r JOIN g USING (win))"""
simple("w_count_above_mean", "count(*) FILTER (x > mu)", None, STATS, "z")
simple("w_count_below_mean", "count(*) FILTER (x < mu)", None, STATS, "z")
simple("w_ratio_beyond_r_sigma", "avg(CASE WHEN abs(x - mu) > 2 * sd THEN 1.0 ELSE 0.0 END)", 6, STATS, "z", r=2)
simple("w_integral", "coalesce(sum(x) - (arg_min(x, i) + arg_max(x, i)) / 2, 0)", 6, STATS, "z WHERE x < q70", q=0.7)
simple("w_gskew", "median(x) FILTER (x <= q03) + median(x) FILTER (x >= q97) - 2 * any_value(med)", 6, STATS, "z")
simple("w_median_BRP", "avg(CASE WHEN x < med + (hi - lo) / 10 AND x > med - (hi - lo) / 10 THEN 1.0 ELSE 0.0 END)", 6, STATS, "z")
CON = STATS + """, f AS (SELECT win, n, abs(x - mu) > 2 * sd AS o, lead(abs(x - mu) > 2 * sd) OVER t AS o1,
  lead(abs(x - mu) > 2 * sd, 2) OVER t AS o2 FROM z WINDOW t AS (PARTITION BY win ORDER BY i))"""
simple("w_con", "count(*) FILTER (o AND o1 AND o2)::DOUBLE / (any_value(n) - 2)", 6, CON, "f")
RUNS = STATS + """, f AS (SELECT win, x {cmp} mu AS flag, i - row_number() OVER (PARTITION BY win, x {cmp} mu ORDER BY i) AS run FROM z),
runs AS (SELECT win, CASE WHEN flag THEN count(*) ELSE 0 END AS len FROM f GROUP BY win, flag, run)"""
simple("w_longest_strike_above_mean", "max(len)", None, RUNS.replace("{cmp}", ">"), "runs")
simple("w_longest_strike_below_mean", "max(len)", None, RUNS.replace("{cmp}", "<"), "runs")
RCS = STATS + ", f AS (SELECT win, n, sd, sum(x - mu) OVER (PARTITION BY win ORDER BY i) AS walk FROM z)"
simple("w_rcs", "(max(walk) - min(walk)) / (any_value(n) * any_value(sd))", 6, RCS, "f")
ORDER = """, o AS (SELECT win, n, x, row_number() OVER (PARTITION BY win ORDER BY x) - 1 AS j FROM r)"""
AT = "max(x) FILTER (j = least(CAST(ceil(CAST({} AS DOUBLE) * n) AS BIGINT), n - 1))"


def spread(lo: float, hi: float) -> str:
    return f"({AT.format(hi)} - {AT.format(lo)})"


simple("w_percent_difference_flux_percentile", f"{spread(0.05, 0.95)} / median(x)", 6, ORDER, "o")
simple("w_flux_percentile_ratio_sum",
       f"({spread(0.4, 0.6)} + {spread(0.25, 0.75)} + {spread(0.1, 0.9)}) / {spread(0.05, 0.95)}", 6, ORDER, "o")
BINS = """, q AS (SELECT r.win, x, lo, hi, n, CAST(floor((x - lo) * (100 / (hi - lo))) AS BIGINT) AS b0 FROM r JOIN
  (SELECT win, min(x) AS lo, max(x) AS hi FROM r GROUP BY win) USING (win)),
q1 AS (SELECT *, least(b0, 99) AS b1 FROM q),
q2 AS (SELECT *, CASE WHEN x < b1 * ((hi - lo) / 100) + lo THEN b1 - 1
                      WHEN b1 < 99 AND x >= (b1 + 1) * ((hi - lo) / 100) + lo THEN b1 + 1 ELSE b1 END AS b FROM q1),
p AS (SELECT win, b, count(*)::DOUBLE / any_value(n) AS share FROM q2 GROUP BY win, b)"""
simple("w_binned_entropy", "-sum(share * ln(share))", 6, BINS, "p")

# spectra
TAIL = """, t AS (SELECT *, least(50, n)::DOUBLE AS k, pi() * i / n AS a FROM r),
d AS (SELECT *, CASE WHEN i = 0 THEN 1.0 ELSE sin(k * a) / (k * sin(a)) END AS g FROM t)"""
simple("w_fft_rmean_last_5000", "sum(x * g * cos(a * (k + 1)))", 6, TAIL, "d", k=50)
simple("w_fft_lmean_last_5000", "sum(x * g * sin(a * (k + 1)))", 6, TAIL, "d", k=50)

# pairs of rows inside a window, at window sizes that SQL can enumerate
SMALL_W, SMALL_S = 60, 60
APEN = f"""WITH {windows_cte(SMALL_W, SMALL_S)},
g AS (SELECT win, 0.5 * stddev_pop(x) AS tol FROM r GROUP BY win),
v AS (SELECT r.win, i, n, tol, x AS x0, lead(x) OVER t AS x1, lead(x, 2) OVER t AS x2, lead(x, 3) OVER t AS x3
      FROM r JOIN g USING (win) WINDOW t AS (PARTITION BY win ORDER BY i)),
pairs AS (SELECT a.win, a.i, a.n, count(*) FILTER (a.x2 IS NOT NULL AND b.x2 IS NOT NULL) AS c3,
    count(*) FILTER (abs(a.x3 - b.x3) <= a.tol) AS c4
  FROM v a JOIN v b ON a.win = b.win AND abs(a.x0 - b.x0) <= a.tol AND abs(a.x1 - b.x1) <= a.tol AND abs(a.x2 - b.x2) <= a.tol
  GROUP BY 1, 2, 3)
SELECT win, round(abs(avg(ln(c3::DOUBLE / (n - 2))) FILTER (i <= n - 3) - avg(ln(c4::DOUBLE / (n - 3))) FILTER (i <= n - 4)), 6) AS y
FROM pairs GROUP BY win"""
window_query("w_approximate_entropy", "w_approximate_entropy", {"m": 3, "r": 0.5}, APEN, 6, SMALL_W, SMALL_S)

SLOTTED = f"""WITH {windows_cte(SMALL_W, SMALL_S)},
g AS (SELECT win, avg(x) AS mu, var_pop(x) AS v FROM r GROUP BY win),
z AS (SELECT win, i, x - mu AS d, v FROM r JOIN g USING (win)),
acf AS (SELECT a.win, b.i - a.i AS lag, avg(a.d * b.d) / any_value(a.v) AS c FROM z a JOIN z b ON a.win = b.win AND b.i > a.i GROUP BY 1, 2)
SELECT k.win, CAST(min(lag) FILTER (c < exp(-1)) AS DOUBLE) AS y FROM k LEFT JOIN acf ON k.win = acf.win GROUP BY k.win"""
window_query("w_slottedA_length", "w_slottedA_length", {}, SLOTTED, None, SMALL_W, SMALL_S)

DFT = f"""WITH {windows_cte(SMALL_W, SMALL_S)},
g AS (SELECT win, avg(x) AS mu FROM r GROUP BY win),
b AS (SELECT r.win, n, f, sum((x - mu) * cos(2 * pi() * f * i / n)) AS re, sum((x - mu) * sin(2 * pi() * f * i / n)) AS im
      FROM r JOIN g USING (win), (SELECT unnest(range({SMALL_W // 2 + 1})) AS f) WHERE f <= n // 2 GROUP BY 1, 2, 3)
SELECT win, f AS bin, round((re * re + im * im) / (4e2 * n) * CASE WHEN f = 0 OR 2 * f = n THEN 1 ELSE 2 END, 4) AS p FROM b"""


@query("w_psd", DFT)
def w_psd(spark, sf):
    df = window_features(event_series(spark, sf), {"y": ("w_psd", {"fs": 4e2})}, SMALL_W, SMALL_S)
    return df.select("win", F.posexplode("y").alias("bin", "p")).select("win", F.col("bin").cast("bigint").alias("bin"), F.round("p", 4).alias("p"))


@query("w_periodogram", DFT + " WHERE f < 20")
def w_periodogram(spark, sf):
    df = window_features(event_series(spark, sf), {"y": ("w_periodogram", {"fs": 4e2, "N": 20})}, SMALL_W, SMALL_S)
    return df.select("win", F.posexplode("y").alias("bin", "p")).select("win", F.col("bin").cast("bigint").alias("bin"), F.round("p", 4).alias("p"))


@query("w_spectrogram_downsampled")
def w_spectrogram_downsampled(spark, sf):
    df = window_features(event_series(spark, sf), {"y": ("w_spectrogram_downsampled", {"fs": 4e2})}, W, S)
    return df.select("win", F.posexplode("y").alias("cell", "p"))


window_query("w_max_smoothed_periodogram", "w_max_smoothed_periodogram", {"fs": 4e2, "window_length": 101, "polyorder": 2}, None, w=W, s=W)
window_query("w_number_cwt_peaks", "w_number_cwt_peaks", {"n": 3}, None, None)


@query("long_series_spectrogram")
def long_series_spectrogram(spark, sf):
    """Frames of the long spectrogram are themselves sliding windows (W = frame, S = frame - overlap)."""
    df = window_features(event_series(spark, sf), {"y": ("w_spectrogram_downsampled", {"fs": 4e2, "nperseg": W, "noverlap": 0})}, W, S)
    return df.select("win", F.posexplode("y").alias("bin", "p"))


@query("w_mean_per_series", f"""WITH {USERS}, c AS (SELECT series_id, count(*) AS n FROM u GROUP BY 1 HAVING count(*) >= 40),
k AS (SELECT series_id, n, unnest(range(CAST(ceil((n - 40 + 15) / 15.0) AS BIGINT))) AS win FROM c)
SELECT u.series_id, win, round(avg(x), 8) AS avg_x, round(median(x), 6) AS med_x FROM k JOIN u ON u.series_id = k.series_id
 AND pos >= win * 15 AND pos < win * 15 + 40 GROUP BY 1, 2""")
def w_mean_per_series(spark, sf):
    df = window_features(user_series(spark, sf), {"a": ("w_mean", {}), "m": ("w_median", {})}, 40, 15, short="drop")
    return df.select("series_id", "win", F.round("a", 8).alias("avg_x"), F.round("m", 6).alias("med_x"))


@query("own_window_operators", by_window("round(max(x) - min(x), 6) AS spread, round(quantile_cont(x, 0.9) - quantile_cont(x, 0.1), 6)"))
def own_window_operators(spark, sf):
    """An own aggregate over panes and an own function of the ordered values, beside the library's."""
    register_aggregate("w_spread", lambda: PaneOp({k: STATS_OF[k] for k in ("n", "min", "max")}, "max - min"))
    register_kernel("w_deciles", "double", lambda w: w.quantile(0.9) - w.quantile(0.1))
    try:
        df = window_features(event_series(spark, sf), {"spread": ("w_spread", {}), "y": ("w_deciles", {})}, W, S)
    finally:
        PANE_OPS.pop("w_spread")
        KERNELS.pop("w_deciles")
    return df.select("win", F.round("spread", 6).alias("spread"), F.round("y", 6).alias("y"))


APEN_W = 1500
window_query("w_approximate_entropy_long", "w_approximate_entropy", {"m": 3, "r": 0.5}, APEN.replace(windows_cte(SMALL_W, SMALL_S), windows_cte(APEN_W, APEN_W)), 6, APEN_W, APEN_W)
