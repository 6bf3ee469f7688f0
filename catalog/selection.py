"""Feature selection, mutual information and feature quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.models import folds as FO
from strideframe.models import selection as SE
from strideframe.models.scaling import fit, transform
from strideframe.operators.windows import window_features
from strideframe.tables import written
from strideframe.sources.tables import event_series, read_table

from . import query
from .validation import COLS, FTAB, features
from .windows import S, W, windows_cte

NAMES = "(SELECT unnest(['avg_x', 'std_x', 'top', 'slope']) AS feature)"
LONG = f"""{FTAB}, lf AS (SELECT feature, ttf, pos, CASE feature WHEN 'avg_x' THEN avg_x WHEN 'std_x' THEN std_x WHEN 'top' THEN top ELSE slope END AS value
FROM t, {NAMES})"""


def entropy(columns: str, source: str, name: str, key: str) -> str:
    return f"""{name} AS (SELECT {key}, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h, sum(c) AS n FROM
(SELECT {key}, count(*)::DOUBLE AS c FROM {source} GROUP BY {key}, {columns}) GROUP BY {key})"""


def information_sql(source: str, key: str) -> str:
    """Mutual information of (a, b) per key."""
    return ", ".join([entropy("a, b", source, "hab", key), entropy("a", source, "ha", key), entropy("b", source, "hb", key)])


BINS = 6
CUTS = ", ".join(f"quantile_cont({{c}}, CAST({i} AS DOUBLE) / {BINS})" for i in range(1, BINS))
BINNED = f"""{LONG}, cv AS (SELECT feature, [{CUTS.format(c='value')}] AS cuts, [{CUTS.format(c='ttf')}] AS lcuts FROM lf GROUP BY feature),
bb AS (SELECT lf.feature, len([q for q in cuts if q <= value]) AS a, len([q for q in lcuts if q <= ttf]) AS b FROM lf JOIN cv USING (feature)),
{information_sql('bb', 'feature')}"""


@query("binned_information", f"""WITH {BINNED} SELECT feature, hab.n::BIGINT AS n, round(greatest(ha.h + hb.h - hab.h, 0), 6) AS mi,
round((ha.h + hb.h - hab.h) / ((ha.h + hb.h) / 2), 6) AS nmi FROM hab JOIN ha USING (feature) JOIN hb USING (feature)""")
def binned(spark, sf):
    out = SE.binned_information(features(spark, sf), COLS, "ttf", BINS)
    return out.select("feature", "n", F.round("mi", 6).alias("mi"), F.round("nmi", 6).alias("nmi"))


@query("top_features", f"""WITH {BINNED} SELECT feature, round(ha.h + hb.h - hab.h, 6) AS mi FROM hab JOIN ha USING (feature) JOIN hb USING (feature)
ORDER BY mi DESC LIMIT 3""")
def top(spark, sf):
    return SE.ranked(SE.binned_information(features(spark, sf), COLS, "ttf", BINS), "mi", 3).select("feature", F.round("mi", 6).alias("mi"))


@query("discrete_information", f"""WITH p AS (SELECT 1 AS k, event_type AS a, user_id AS b FROM events), {information_sql('p', 'k')}
SELECT hab.n::BIGINT AS n, round(ha.h, 6) AS h_a, round(hb.h, 6) AS h_b, round(ha.h + hb.h - hab.h, 6) AS mi FROM hab JOIN ha USING (k) JOIN hb USING (k)""")
def discrete(spark, sf):
    out = SE.discrete_information(read_table(spark, sf, "events"), "event_type", "user_id")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("h_a", "h_b", "mi")])


def embedded(spark, sf, size: int = 64):
    emb = read_table(spark, sf, "embeddings")
    return emb.select("label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(size)]), [f"e{i}" for i in range(size)]


EMB = "t AS (SELECT label, unnest(range(64)) AS i, embedding FROM embeddings), lf AS (SELECT 'e' || i AS feature, label, embedding[i + 1]::DOUBLE AS value FROM t)"


@query("class_information", f"""WITH {EMB}, cv AS (SELECT feature, [{CUTS.format(c='value')}] AS cuts FROM lf GROUP BY feature),
bb AS (SELECT lf.feature, len([q for q in cuts if q <= value]) AS a, label AS b FROM lf JOIN cv USING (feature)),
{information_sql('bb', 'feature')}
SELECT feature, round(ha.h + hb.h - hab.h, 6) AS mi FROM hab JOIN ha USING (feature) JOIN hb USING (feature)""")
def class_information(spark, sf):
    df, cols = embedded(spark, sf)
    return SE.binned_information(df, cols, "label", BINS, discrete_label=True).select("feature", F.round("mi", 6).alias("mi"))


def digamma_sql(m: str) -> str:
    """Digamma of a whole number: the asymptotic series at m + 6, and the recurrence back."""
    z, back = f"({m} + 6.0::DOUBLE)", " + ".join(f"1 / ({m} + {j}.0::DOUBLE)" for j in range(6))
    return f"(ln{z} - 1 / (2 * {z}) - 1 / (12 * {z} ** 2) + 1 / (120 * {z} ** 4) - 1 / (252 * {z} ** 6) + 1 / (240 * {z} ** 8) - ({back}))"


STEP = "floor(({c} - avg({c}) OVER f) / stddev_pop({c}) OVER f * 4294967296.0::DOUBLE + 0.5)::BIGINT"
NEAREST = f"""{LONG}, p AS (SELECT feature, pos, {STEP.format(c='value')} AS a, {STEP.format(c='ttf')} AS b, count(*) OVER f AS n
FROM lf WHERE value IS NOT NULL WINDOW f AS (PARTITION BY feature)),
kr AS (SELECT p.feature, p.pos, any_value(p.a) AS a, any_value(p.b) AS b, any_value(p.n) AS n, min(greatest(abs(p.a - q.a), abs(p.b - q.b)), 3)[3] AS r
FROM p JOIN p q ON p.feature = q.feature AND p.pos <> q.pos GROUP BY p.feature, p.pos),
cn AS (SELECT kr.feature, kr.pos, any_value(kr.n) AS n, count(*) FILTER (abs(kr.a - q.a) < r OR kr.a = q.a) AS na,
count(*) FILTER (abs(kr.b - q.b) < r OR kr.b = q.b) AS nb FROM kr JOIN p q USING (feature) GROUP BY kr.feature, kr.pos)"""


@query("neighbour_information", f"""WITH {NEAREST} SELECT feature, any_value(n)::BIGINT AS n, round(greatest({digamma_sql('any_value(n)')} + {digamma_sql('3')}
- avg({digamma_sql('na')} + {digamma_sql('nb')}), 0), 6) AS mi FROM cn GROUP BY feature""")
def neighbour_information(spark, sf):
    return SE.nearest_information(features(spark, sf), COLS, "ttf").select("feature", "n", F.round("mi", 6).alias("mi"))


@query("f_regression", f"""WITH {LONG} SELECT feature, round(corr(value, ttf), 6) AS r,
round(corr(value, ttf) ** 2 / (1 - corr(value, ttf) ** 2) * (count(*) - 2), 5) AS f FROM lf GROUP BY feature""")
def f_scores(spark, sf):
    return SE.f_regression(features(spark, sf), COLS, "ttf").select("feature", F.round("r", 6).alias("r"), F.round("f", 5).alias("f"))


@query("variances", f"WITH {EMB} SELECT feature, round(var_pop(value), 6) AS variance FROM lf GROUP BY feature")
def variances(spark, sf):
    df, cols = embedded(spark, sf)
    return SE.variances(df, cols).select("feature", F.round("variance", 6).alias("variance"))


def listed(name: str, sql: str | None = None):
    """Register a function that returns column names, as a one-column table."""

    def register(fn):
        query(name, sql)(lambda spark, sf: spark.createDataFrame([(c,) for c in fn(spark, sf)], "feature string"))
        return fn

    return register


@listed("variance_threshold", f"WITH {LONG} SELECT feature FROM lf GROUP BY feature HAVING var_pop(value) > 0.16")
def above_variance(spark, sf):
    return SE.variance_threshold(features(spark, sf), COLS, 0.16)


@listed("select_percentile", f"""WITH {BINNED} SELECT feature FROM hab JOIN ha USING (feature) JOIN hb USING (feature)
ORDER BY round(ha.h + hb.h - hab.h, 9) DESC, feature LIMIT 2""")
def percentile(spark, sf):
    return SE.select_percentile(SE.binned_information(features(spark, sf), COLS, "ttf", BINS), "mi", 50, COLS)


@listed("univariate_top", f"WITH {LONG} SELECT feature FROM lf GROUP BY feature ORDER BY abs(corr(value, ttf)) DESC LIMIT 2")
def univariate_top(spark, sf):
    return SE.univariate_selection(features(spark, sf), COLS, "ttf", "numTopFeatures", 2)


@listed("univariate_fdr")
def univariate_fdr(spark, sf):
    return SE.univariate_selection(features(spark, sf), COLS, "ttf", "fdr", 0.9)


@listed("univariate_fpr")
def univariate_fpr(spark, sf):
    return SE.univariate_selection(features(spark, sf), COLS, "ttf", "fpr", 0.5)


# coefficients of a linear model of two features, by the normal equations
TWO = f"""{FTAB}, mm AS (SELECT covar_pop(std_x, std_x) AS aa, covar_pop(top, top) AS bb, covar_pop(std_x, top) AS ab, covar_pop(std_x, ttf) AS ya, covar_pop(top, ttf) AS yb FROM t),
w AS (SELECT (bb * ya - ab * yb) / (aa * bb - ab * ab) AS wa, (aa * yb - ab * ya) / (aa * bb - ab * ab) AS wb FROM mm)"""


@query("recursive_elimination", f"""WITH {TWO} SELECT 'std_x' AS feature, CASE WHEN abs(wa) > abs(wb) THEN 1 ELSE 2 END::INTEGER AS place FROM w
UNION ALL SELECT 'top', CASE WHEN abs(wa) > abs(wb) THEN 2 ELSE 1 END FROM w""")
def elimination(spark, sf):
    _, ranking = SE.recursive_elimination(features(spark, sf), ["std_x", "top"], "ttf", 1, "LinearRegression")
    return spark.createDataFrame(sorted(ranking.items()), "feature string, place int")


@query("recursive_elimination_tree")
def elimination_tree(spark, sf):
    _, ranking = SE.recursive_elimination(features(spark, sf), COLS, "ttf", 2, params={"max_depth": 3})
    return spark.createDataFrame(sorted(ranking.items()), "feature string, place int")


@query("recursive_elimination_cv")
def elimination_cv(spark, sf):
    df = written(features(spark, sf), "table")
    folds = written(FO.block_folds(df, df.count(), 2, 0.0, 2), "table")
    best, tried = SE.recursive_elimination_cv(folds, COLS, "ttf", "DecisionTreeRegressor", {"max_depth": 3}, step=2, minimum=2)
    return spark.createDataFrame([(size, float(value), size == len(best)) for size, value in tried], "size int, score double, best boolean")


@query("two_stage_linear", f"""WITH {TWO}, {BINNED.removeprefix(FTAB + ',')},
ss AS (SELECT feature FROM hab JOIN ha USING (feature) JOIN hb USING (feature) WHERE feature IN ('std_x', 'top') ORDER BY ha.h + hb.h - hab.h DESC LIMIT 2),
kk AS (SELECT CASE WHEN abs(wa) > abs(wb) THEN 'std_x' ELSE 'top' END AS feature FROM w WHERE (SELECT count(*) FROM ss) = 2)
SELECT kk.feature, count(*) AS n, round(sum(value), 4) AS total FROM lf JOIN kk USING (feature) GROUP BY 1""")
def two_stage_linear(spark, sf):
    out = SE.two_stage_elimination(features(spark, sf).select("std_x", "top", "ttf"), "ttf", 100, 1, "LinearRegression", bins=BINS)
    return out.select(F.lit(out.columns[0]).alias("feature"), F.col(out.columns[0]).alias("v")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("two_stage_elimination")
def two_stage(spark, sf):
    return SE.two_stage_elimination(features(spark, sf).drop("pos"), "ttf", 75, 2, params={"max_depth": 3})


# one scaled feature at a time: it is selected where its covariance with the label exceeds the penalty
@listed("lasso_selection", f"WITH {LONG} SELECT feature FROM lf GROUP BY feature HAVING abs(corr(value, ttf) * stddev_pop(ttf)) > 5.0")
def lasso(spark, sf):
    df = written(features(spark, sf), "table")
    df = transform(df, COLS, fit(df, COLS))
    return [c for c in COLS if SE.lasso_selection(df, [c], "ttf", 5.0)]


@listed("lasso_selection_joint")
def lasso_joint(spark, sf):
    return SE.lasso_selection(features(spark, sf), COLS, "ttf", 5.0)


@listed("importance_selection")
def important(spark, sf):
    return SE.importance_selection(features(spark, sf), COLS, "ttf", params={"n_estimators": 5, "max_depth": 3})


def moved_sql(w: int) -> str:
    source = f"SELECT event_id AS pos, avg(value) OVER (ORDER BY event_id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS x FROM events"
    return f"SELECT {w}::DOUBLE AS param, win, value FROM (WITH {windows_cte(source=source)} SELECT win, stddev_pop(x) AS value FROM r GROUP BY win)"


SWEEP_CUTS = ", ".join(f"quantile_cont({{c}}, CAST({i} AS DOUBLE) / 8)" for i in range(1, 8))


@query("parameter_sweep", f"""WITH {FTAB}, v AS ({' UNION ALL '.join(map(moved_sql, (3, 13, 53)))}), lf AS (SELECT param, value, ttf FROM v JOIN t ON pos = win),
cv AS (SELECT param, [{SWEEP_CUTS.format(c='value')}] AS cuts, [{SWEEP_CUTS.format(c='ttf')}] AS lcuts FROM lf GROUP BY param),
bb AS (SELECT lf.param, len([q for q in cuts if q <= value]) AS a, len([q for q in lcuts if q <= ttf]) AS b FROM lf JOIN cv USING (param)),
{information_sql('bb', 'param')} SELECT param, round(ha.h + hb.h - hab.h, 6) AS mi, round((ha.h + hb.h - hab.h) / ((ha.h + hb.h) / 2), 6) AS nmi
FROM hab JOIN ha USING (param) JOIN hb USING (param)""")
def sweep(spark, sf):
    s = event_series(spark, sf, label=True)
    tables = {w: window_features(s, {"v": ("w_std", {})}, W, S, rows=[("r_mean", {"window_size": w})], label=True) for w in (3, 13, 53)}
    return SE.parameter_sweep(tables, "v", "ttf", 8).select("param", F.round("mi", 6).alias("mi"), F.round("nmi", 6).alias("nmi"))


@query("parameter_sweep_savgol")
def sweep_savgol(spark, sf):
    """The sweep over the smoothing filter, without SQL."""
    s = event_series(spark, sf, label=True)
    tables = {w: window_features(s, {"v": ("w_std", {})}, W, S, rows=[("r_savgol_filter", {"window_length": w})], label=True) for w in (3, 13, 53)}
    return SE.parameter_sweep(tables, "v", "ttf", 8).select("param", F.round("mi", 6).alias("mi"), F.round("nmi", 6).alias("nmi"))


QUALITY = f"""{LONG}, q AS (SELECT feature, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM lf GROUP BY feature),
cl AS (SELECT feature, pos, least(greatest(value, lo), hi) AS v FROM lf JOIN q USING (feature)),
st AS (SELECT feature, avg(v) AS a, stddev_pop(v) AS b, count(*) AS n FROM cl GROUP BY feature),
z AS (SELECT feature, pos, (v - a) / b AS z, n FROM cl JOIN st USING (feature)),
sm AS (SELECT feature, pos, n, z, avg(z) OVER o AS m, count(*) OVER o AS c FROM z
       WINDOW o AS (PARTITION BY feature ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
hd AS (SELECT feature, avg(z) AS a, sum(z * (pos - 2)) / 10 AS b FROM z WHERE pos < 5 GROUP BY feature),
tl AS (SELECT feature, avg(z) AS a, sum(z * (pos - (n - 3))) / 10 AS b FROM z WHERE pos >= n - 5 GROUP BY feature),
y AS (SELECT sm.feature, sm.pos, n, z, CASE WHEN pos < 2 THEN hd.a + hd.b * (pos - 2) WHEN pos > n - 3 THEN tl.a + tl.b * (pos - (n - 3)) ELSE m END AS y,
      (pos / (n - 1.0::DOUBLE) - 0.5) / sqrt((n + 1) / (12.0::DOUBLE * (n - 1))) AS line FROM sm JOIN hd USING (feature) JOIN tl USING (feature))
SELECT feature, round(sqrt(sum((z - y) ** 2)) / any_value(n) * 100, 5) AS rmse, round(abs(sum(z - y)) / any_value(n), 6) AS l1,
round(least(sqrt(sum((z - line) ** 2)), sqrt(sum((z + line) ** 2))) / any_value(n) * 100, 5) AS non_linearity FROM y GROUP BY feature"""


@query("feature_quality", f"WITH {QUALITY}")
def quality(spark, sf):
    out = SE.feature_quality(features(spark, sf), COLS, window_length=5, polyorder=1, order="pos")
    return out.select("feature", F.round("rmse", 5).alias("rmse"), F.round("l1", 6).alias("l1"), F.round("non_linearity", 5).alias("non_linearity"))


@query("repeated_scores", f"""WITH {FTAB}, shifted AS (SELECT ttf, avg_x + shift AS p, shift FROM t, (SELECT unnest([0, 10, 20]) AS shift)),
errors AS (SELECT shift, avg(abs(ttf - p)) AS e FROM shifted GROUP BY shift) SELECT round(median(e), 4) AS mean_absolute_error FROM errors""")
def repeated(spark, sf):
    df = features(spark, sf)
    parts = {k: df.select(F.col("ttf").alias("y"), (F.col("avg_x") + 10 * k).alias("prediction")) for k in range(3)}
    return SE.repeated_scores(parts, "mean_absolute_error").select(F.round("mean_absolute_error", 4).alias("mean_absolute_error"))
