"""Feature tables from chain specs (window sizes scaled to the test tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators.resample import resample
from strideframe.operators.rolling import rolled
from strideframe.operators.windows import window_features
from strideframe.plans.features import build_feature, build_features, feature_grid, smooth_columns, widen
from strideframe.sources.tables import event_series

from . import query
from .rows import last
from .windows import DFT, LEAD, S, SMALL_S, SMALL_W, W, windows_cte

LABELLED = """lab AS (SELECT event_id AS pos, value AS x, (epoch_us(min(CASE WHEN event_type = 'error' THEN ts END)
  OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) - epoch_us(ts)) / 1e6 AS ttf FROM events)"""
LABEL = f"""{LABELLED}, tt AS (SELECT win, ttf FROM k JOIN lab ON pos = least(win * {S} + {W}, total) - 1)"""


def std_rows(w: int) -> str:
    return f"SELECT event_id AS pos, stddev_pop(value) OVER {last(w)} AS x FROM events"


def table_sql(features: dict[str, tuple[str, str]], label: bool = True, digits: int = 5) -> str:
    """``{name: (row source, window expression)}`` as one wide table."""
    ctes, joins = [], []
    for i, (name, (source, expr)) in enumerate(features.items()):
        cte = windows_cte(source=source)
        for alias in ("e", "m", "k", "r"):
            cte = cte.replace(f"{alias} AS (", f"{alias}{i} AS (")
        cte = cte.replace("FROM e)", f"FROM e{i})").replace("FROM m)", f"FROM m{i})").replace("FROM k JOIN e ON", f"FROM k{i} JOIN e{i} ON")
        ctes += [cte, f"f{i} AS (SELECT win, round({expr}, {digits}) AS {name} FROM r{i} GROUP BY win)"]
        joins.append(f"f{i}")
    if label:
        ctes.append(LABEL.replace("FROM k JOIN", "FROM k0 JOIN"))
    tail = " JOIN ".join([joins[0], *[f"{j} USING (win)" for j in joins[1:]], *(["tt USING (win)"] if label else [])])
    cols = ", ".join(["win", *features, *(["round(ttf, 6) AS ttf"] if label else [])])
    return f"WITH {', '.join(ctes)} SELECT {cols} FROM {tail}"


def spec(name, features: dict, sql: str | None, label=True, digits=5):
    chains = [{"name": k, "on": True, "functions": f} for k, f in features.items()]

    def run(spark, sf):
        df = build_features(event_series(spark, sf, label=label), chains, W, S)
        return df.select("win", *[F.round(k, digits).alias(k) for k in features], *([F.round("ttf", 6).alias("ttf")] if label else []))

    query(name, sql)(run)


RAW = "SELECT event_id AS pos, value AS x FROM events"
Q05 = "quantile_cont(x, 0.05)"
spec("table_moving_std_quantiles", {
    "q_05_std_rolling_10": {"r_std": {"window_size": 10}, "w_quantile": {"q": 0.05}},
    "q_05_std_rolling_50": {"r_std": {"window_size": 50}, "w_quantile": {"q": 0.05}},
    "q_05_std_rolling_200": {"r_std": {"window_size": 200}, "w_quantile": {"q": 0.05}},
    "psd_sum": {"w_psd_sum": {}},
}, table_sql({"q_05_std_rolling_10": (std_rows(10), Q05), "q_05_std_rolling_50": (std_rows(50), Q05),
              "q_05_std_rolling_200": (std_rows(200), Q05), "psd_sum": (RAW, "count(*) * var_pop(x) / 4e6")}))

Q_INT = f"""WITH {windows_cte(source=std_rows(50))},
g AS (SELECT win, quantile_cont(x, 0.1) AS q FROM r GROUP BY win),
a AS (SELECT win, round(coalesce(sum(x) - (arg_min(x, i) + arg_max(x, i)) / 2, 0), 5) AS integral FROM r JOIN g USING (win) WHERE x < q GROUP BY win),
b AS (SELECT win, round(quantile_cont(x, 0.01), 5) AS q01, round(stddev_pop(x), 5) AS std FROM r GROUP BY win){LEAD},
c AS (SELECT win, round(avg(x * x10 * x20), 5) AS c3 FROM l GROUP BY win),
raw AS (SELECT win, value AS x, lead(value, 2) OVER (PARTITION BY win ORDER BY event_id) AS x2 FROM k JOIN events
        ON event_id >= win * {S} AND event_id < win * {S} + {W}),
d AS (SELECT win, round((sum(x * x2) - avg(x) * (sum(x) FILTER (x2 IS NOT NULL) + sum(x2)) + (count(*) - 2) * avg(x) * avg(x))
        / ((count(*) - 2) * var_pop(x)), 5) AS ac FROM raw GROUP BY win),
{LABEL}
SELECT win, integral, q01, c3, std, ac, round(ttf, 6) AS ttf FROM a JOIN b USING (win) JOIN c USING (win) JOIN d USING (win) JOIN tt USING (win)"""
STD50 = {"r_std": {"window_size": 50}}
spec("table_shared_prefix", {
    "integral": {**STD50, "w_integral": {"q": 0.1}}, "q01": {**STD50, "w_quantile": {"q": 0.01}},
    "c3": {**STD50, "w_c3": {"lag": 10}}, "std": {**STD50, "w_std": {}}, "ac": {"w_autocorrelation": {"lag": 2}},
}, Q_INT)

CLIPPED = f"""WITH {windows_cte(source=std_rows(50))}, f AS (SELECT win, quantile_cont(x, 0.01) AS q FROM r GROUP BY win)
SELECT win, round(least(greatest(q, (SELECT quantile_cont(q, 0.01) FROM f)), (SELECT quantile_cont(q, 0.99) FROM f)), 5) AS clipped FROM f"""
spec("table_window_then_clip", {"clipped": {**STD50, "w_quantile": {"q": 0.01}, "r_clip": {}}}, CLIPPED, label=False)

spec("table_integral", {"integral_std_rolling_100": {"r_std": {"window_size": 100}, "w_integral": {"q": 0.1}}}, f"""
WITH {windows_cte(source=std_rows(100))}, g AS (SELECT win, quantile_cont(x, 0.1) AS q FROM r GROUP BY win), {LABEL},
a AS (SELECT win, coalesce(sum(x) - (arg_min(x, i) + arg_max(x, i)) / 2, 0) AS y FROM r JOIN g USING (win) WHERE x < q GROUP BY win)
SELECT win, round(y, 5) AS integral_std_rolling_100, round(ttf, 6) AS ttf FROM a JOIN tt USING (win)""")


def sta_lta_rows(a: int, b: int) -> str:
    return f"""SELECT event_id AS pos, CASE WHEN event_id < {b - 1} THEN 0 ELSE sum(value * value) OVER {last(a)} / {a} END
      / greatest(sum(value * value) OVER {last(b)} / {b}, 2.2250738585072014e-308) AS x FROM events"""


STA = {"r_sta_lta": {"sta_window": 11, "lta_window": 110}}
STA2 = {"r_sta_lta": {"sta_window": 40, "lta_window": 400}}
spec("table_sta_lta_shapes", {
    "mean_sta_lta": {**STA, "w_mean": {}}, "q005": {"w_quantile": {"q": 0.05}}, "q095": {"w_quantile": {"q": 0.95}},
    "q05": {"w_quantile": {"q": 0.5}}, "kur_sta_lta": {**STA, "w_kurtosis": {}}, "skew_sta_lta": {**STA, "w_skewness": {}},
    "kur_sta_lta_long": {**STA2, "w_kurtosis": {}}, "skew_sta_lta_long": {**STA2, "w_skewness": {}},
}, table_sql({"mean_sta_lta": (sta_lta_rows(11, 110), "avg(x)"), "q005": (RAW, Q05), "q095": (RAW, "quantile_cont(x, 0.95)"),
              "q05": (RAW, "median(x)"), "kur_sta_lta": (sta_lta_rows(11, 110), "kurtosis(x)"),
              "skew_sta_lta": (sta_lta_rows(11, 110), "skewness(x)"), "kur_sta_lta_long": (sta_lta_rows(40, 400), "kurtosis(x)"),
              "skew_sta_lta_long": (sta_lta_rows(40, 400), "skewness(x)")}))

SMOOTHED = f"""WITH {windows_cte()}, f AS (SELECT win AS pos, avg(x) AS x FROM r GROUP BY win),
m2 AS (SELECT max(pos) + 1 AS total FROM f), k2 AS (SELECT unnest(range(CAST(total - 9 AS BIGINT))) AS win FROM m2),
g AS (SELECT win, round(median(x), 5) AS med FROM k2 JOIN f ON pos >= win AND pos < win + 10 GROUP BY win)
SELECT * FROM g"""


@query("window_over_windows", SMOOTHED)
def window_over_windows(spark, sf):
    chain = [{"name": "med", "functions": [("w_mean", {}), ("w_median", {"window_size": 10, "window_stride": 1})]}]
    return build_feature(event_series(spark, sf), chain, "med", W, S).select("win", F.round("med", 5).alias("med"))


RESAMPLED = f"""t AS (SELECT g.win, (SELECT count(*) FROM f) AS n_old, g.n_new, g.win * ((SELECT count(*) FROM f) - 1.0::DOUBLE) / (g.n_new - 1) AS t
  FROM (SELECT win, count(*) OVER () AS n_new FROM grid) g)
SELECT t.win, round(a.x + (t - floor(t)) * coalesce(b.x - a.x, 0), 5) AS x FROM t JOIN f a ON a.pos = floor(t) LEFT JOIN f b ON b.pos = floor(t) + 1"""


@query("resample_up", f"""WITH {windows_cte(W, 300)}, f AS (SELECT win AS pos, avg(x) AS x FROM r GROUP BY win),
grid AS (SELECT unnest(range(250)) AS win), {RESAMPLED}""")
def resample_up(spark, sf):
    df = window_features(event_series(spark, sf), {"x": ("w_mean", {})}, W, 300)
    return resample(df, ["x"], 250).select("win", F.round("x", 5).alias("x"))


@query("resample_rows_down", f"""WITH f AS ({std_rows(50)}), grid AS (SELECT unnest(range(777)) AS win), {RESAMPLED}""")
def resample_rows_down(spark, sf):
    df = rolled(event_series(spark, sf), [("r_std", {"window_size": 50})]).withColumnRenamed("pos", "win")
    return resample(df, ["x"], 777).select("win", F.round("x", 5).alias("x"))


@query("table_mixed_grids", f"""WITH {windows_cte()}, grid AS (SELECT DISTINCT win FROM r),
base AS (SELECT win, round(avg(x), 5) AS avg_x FROM r GROUP BY win),
k9 AS (SELECT unnest(range(CAST(ceil((total - 200 + 300) / 300.0) AS BIGINT))) AS win FROM m),
f AS (SELECT win AS pos, max(x) AS x FROM k9 JOIN e ON pos >= win * 300 AND pos < win * 300 + 200 GROUP BY win),
res AS (SELECT * FROM (WITH {RESAMPLED}))
SELECT base.win, avg_x, res.x AS max_x FROM base JOIN res USING (win)""")
def table_mixed_grids(spark, sf):
    chains = [{"name": "avg_x", "functions": {"w_mean": {}}},
              {"name": "max_x", "functions": {"w_max": {"window_size": 200, "window_stride": 300}}},
              {"name": "off", "on": False, "functions": {"w_min": {}}}]
    df = build_features(event_series(spark, sf), chains, W, S)
    return df.select("win", F.round("avg_x", 5).alias("avg_x"), F.round("max_x", 5).alias("max_x"))


PSD_BINS = SMALL_W // 2 + 1


@query("array_feature_columns", f"SELECT win, {', '.join(f'max(p) FILTER (bin = {i}) AS psd_{i}' for i in range(PSD_BINS))} FROM ({DFT}) GROUP BY win")
def array_feature_columns(spark, sf):
    chain = [{"name": "psd", "functions": {"w_psd": {"fs": 4e2}}}]
    df = widen(build_features(event_series(spark, sf), chain, SMALL_W, SMALL_S), "psd", PSD_BINS)
    return df.select("win", *[F.round(f"psd_{i}", 4).alias(f"psd_{i}") for i in range(PSD_BINS)])


# the grid's four windows, scaled to the test tables
GRID = (5, 11, 31, 101)


@query("feature_grid")
def grid(spark, sf):
    return build_features(event_series(spark, sf, label=True), feature_grid(windows=GRID), W, S)


SMOOTH = f"""WITH {windows_cte()}, f AS (SELECT win, avg(x) AS a, max(x) AS b FROM r GROUP BY win), n AS (SELECT count(*) AS n FROM f),
lf AS (SELECT win, k, CASE k WHEN 0 THEN a ELSE b END AS v, n FROM f, n, (SELECT unnest([0, 1]) AS k)),
mid AS (SELECT *, avg(v) OVER (PARTITION BY k ORDER BY win ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM lf),
hd AS (SELECT k, avg(v) AS a, sum(v * (win - 2)) / 10 AS b FROM lf WHERE win < 5 GROUP BY k),
tl AS (SELECT k, avg(v) AS a, sum(v * (win - (n - 3))) / 10 AS b FROM lf WHERE win >= n - 5 GROUP BY k),
y AS (SELECT win, k, CASE WHEN win < 2 THEN hd.a + hd.b * (win - 2) WHEN win > n - 3 THEN tl.a + tl.b * (win - (n - 3)) ELSE m END AS y
      FROM mid JOIN hd USING (k) JOIN tl USING (k))
SELECT win, round(max(y) FILTER (k = 0), 6) AS avg_x, round(max(y) FILTER (k = 1), 6) AS max_x FROM y GROUP BY win"""


@query("smooth_columns", SMOOTH)
def smoothed(spark, sf):
    df = window_features(event_series(spark, sf), {"avg_x": ("w_mean", {}), "max_x": ("w_max", {})}, W, S)
    out = smooth_columns(df, ["avg_x", "max_x"], 5, 1)
    return out.select("win", F.round("avg_x", 6).alias("avg_x"), F.round("max_x", 6).alias("max_x"))
