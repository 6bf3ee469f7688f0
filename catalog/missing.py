"""Signals with missing values: the value is NULL where the event is an error."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators.rolling import rolled
from strideframe.operators.windows import window_features
from strideframe.series import series
from strideframe.sources.tables import read_table

from . import query
from .rows import last
from .windows import windows_cte

W, S = 300, 60
SOURCE = "SELECT event_id AS pos, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS x FROM events"


def gappy_series(spark, sf):
    return series(read_table(spark, sf, "events"), "event_id", F.when(F.col("event_type") != "error", F.col("value")))


def rows_query(name: str, op: str, params: dict, sql: str, digits: int = 6) -> None:
    query(name, f"WITH e AS ({SOURCE}) SELECT pos, round({sql}, {digits}) AS x FROM e")(
        lambda spark, sf: rolled(gappy_series(spark, sf), [(op, params)]).select("pos", F.round("x", digits).alias("x")))


over = last(40).replace("event_id", "pos")
rows_query("r_mean_missing", "r_mean", {"window_size": 40}, f"avg(x) OVER {over}", 8)
rows_query("r_std_missing", "r_std", {"window_size": 40}, f"stddev_pop(x) OVER {over}")
rows_query("r_clip_missing", "r_clip", {"q_low": 0.1, "q_high": 0.9}, """CASE WHEN x IS NOT NULL THEN
  least(greatest(x, (SELECT quantile_cont(x, 0.1) FROM e)), (SELECT quantile_cont(x, 0.9) FROM e)) END""")
rows_query("r_sta_lta_missing", "r_sta_lta", {"sta_window": 20, "lta_window": 200}, f"""
  CASE WHEN pos < 199 THEN 0 ELSE coalesce(sum(x * x) OVER {last(20).replace('event_id', 'pos')}, 0) / 20 END
  / greatest(coalesce(sum(x * x) OVER {last(200).replace('event_id', 'pos')}, 0) / 200, 2.2250738585072014e-308)""")

FEATURES = {
    "mean": ("w_mean", {}), "std": ("w_std", {}), "median": ("w_median", {}), "q05": ("w_quantile", {"q": 0.05}), "kurtosis": ("w_kurtosis", {}),
    "trend": ("w_linear_trend", {}), "top": ("w_first_location_of_maximum", {}), "final": ("w_last_elem", {}), "change": ("w_mean_abs_change", {}),
    "cubic": ("w_c3", {"lag": 3}), "above": ("w_count_above_mean", {}), "below": ("w_count_below_mean", {}),
    "run_above": ("w_longest_strike_above_mean", {}), "run_below": ("w_longest_strike_below_mean", {}), "brp": ("w_median_BRP", {}),
}
DIGITS = {"cubic": 2, "trend": 7, "kurtosis": 5}


@query("w_missing_values", f"""WITH {windows_cte(W, S, SOURCE)},
g AS (SELECT win, avg(x) AS mu, median(x) AS med, min(x) AS lo, max(x) AS hi FROM r GROUP BY win),
l AS (SELECT *, lead(x) OVER t AS x1, lead(x, 3) OVER t AS x3, lead(x, 6) OVER t AS x6 FROM r JOIN g USING (win) WINDOW t AS (PARTITION BY win ORDER BY i)),
v AS (SELECT win, x, mu, row_number() OVER (PARTITION BY win ORDER BY i) AS j FROM l WHERE x IS NOT NULL),
f AS (SELECT win, x > mu AS up, x < mu AS down, j - row_number() OVER (PARTITION BY win, x > mu, x < mu ORDER BY j) AS run FROM v),
runs AS (SELECT win, coalesce(max(c) FILTER (up), 0) AS run_above, coalesce(max(c) FILTER (down), 0) AS run_below
  FROM (SELECT win, up, down, run, count(*) AS c FROM f GROUP BY ALL) GROUP BY win),
a AS (SELECT win, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(median(x), 6) AS median, round(quantile_cont(x, 0.05), 6) AS q05,
  round(kurtosis(x), 5) AS kurtosis, round(regr_slope(x, i), 7) AS trend, round(arg_max(i, {{'x': x, 'p': -i}}) FILTER (x IS NOT NULL)::DOUBLE / any_value(n), 6) AS top,
  round(arg_max(x, i) FILTER (x IS NOT NULL), 6) AS final, round(avg(abs(x1 - x)), 6) AS change, round(avg(x * x3 * x6), 2) AS cubic,
  count(*) FILTER (x > mu) AS above, count(*) FILTER (x < mu) AS below,
  round(avg(CASE WHEN x < med + (hi - lo) / 10 AND x > med - (hi - lo) / 10 THEN 1.0 ELSE 0.0 END) FILTER (x IS NOT NULL), 6) AS brp FROM l GROUP BY win)
SELECT a.*, run_above, run_below FROM a JOIN runs USING (win)""")
def missing_values(spark, sf):
    df = window_features(gappy_series(spark, sf), FEATURES, W, S)
    whole = {"above", "below", "run_above", "run_below"}
    return df.select("win", *[F.col(c) if c in whole else F.round(c, DIGITS.get(c, 6)).alias(c) for c in FEATURES])


LONG_W, LONG_S = 5000, 50
LONG_FEATURES = {
    "median": ("w_median", {}), "q05": ("w_quantile", {"q": 0.05}), "irq": ("w_irq", {}), "above": ("w_count_above_mean", {}), "below": ("w_count_below_mean", {}),
    "brp": ("w_median_BRP", {}), "integral": ("w_integral", {"q": 0.7}), "gskew": ("w_gskew", {}),
}


@query("w_missing_values_long", f"""WITH {windows_cte(LONG_W, LONG_S, SOURCE)},
g AS (SELECT win, avg(x) AS mu, median(x) AS med, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.7) AS q70, quantile_cont(x, 0.03) AS q03, quantile_cont(x, 0.97) AS q97,
  quantile_cont(x, 0.05) AS q05, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS irq FROM r GROUP BY win)
SELECT win, round(any_value(med), 6) AS median, round(any_value(q05), 6) AS q05, round(any_value(irq), 6) AS irq, count(*) FILTER (x > mu) AS above, count(*) FILTER (x < mu) AS below,
  round(avg(CASE WHEN x < med + (hi - lo) / 10 AND x > med - (hi - lo) / 10 THEN 1.0 ELSE 0.0 END) FILTER (x IS NOT NULL), 6) AS brp,
  round(sum(x) FILTER (x < q70) - (arg_min(x, i) FILTER (x < q70) + arg_max(x, i) FILTER (x < q70)) / 2, 4) AS integral,
  round(median(x) FILTER (x <= q03) + median(x) FILTER (x >= q97) - 2 * any_value(med), 6) AS gskew
FROM r JOIN g USING (win) GROUP BY win""")
def missing_values_long(spark, sf):
    """Long windows of small stride over a signal with holes: ranks, sums and ends move with the window."""
    df = window_features(gappy_series(spark, sf), LONG_FEATURES, LONG_W, LONG_S, short="drop")
    return df.select("win", *[F.col(c) if c in ("above", "below") else F.round(c, 4 if c == "integral" else 6).alias(c) for c in LONG_FEATURES])
