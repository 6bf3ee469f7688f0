"""Folds, scalers, models, metrics, run summaries and segment scoring over a feature table of the event signal."""

from __future__ import annotations

import functools

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from strideframe.functions.slices import random_slice
from strideframe.models import folds as FO
from strideframe.models import runs
from strideframe.models.estimators import binned_classifier, class_centre, create_model, ensemble_mean, register_model
from strideframe.models.metrics import METRICS, score, score_summary
from strideframe.models.scaling import fit, scale_folds, transform
from strideframe.operators.quantiles import exact_quantiles
from strideframe.operators.windows import window_features
from strideframe.tables import written
from strideframe.sources.tables import event_series, read_table, user_series
from strideframe.sources.writers import append_summary, latest_predictions, read_summary, write_submission

from . import query
from .preparation import scratch
from .rows import USERS
from .specs import LABEL
from .windows import S, W, windows_cte

FEATURES = {"avg_x": ("w_mean", {}), "std_x": ("w_std", {}), "top": ("w_max", {}), "slope": ("w_linear_trend", {})}
COLS = list(FEATURES)


def features(spark, sf):
    """One row per labelled window: ``pos`` and four features."""
    df = window_features(event_series(spark, sf, label=True), FEATURES, W, S, label=True)
    return df.filter("ttf is not null").select(F.col("win").alias("pos"), *COLS, "ttf")


FTAB = f"""{windows_cte()}, {LABEL},
t AS (SELECT win AS pos, avg(x) AS avg_x, stddev_pop(x) AS std_x, max(x) AS top, regr_slope(x, i) AS slope, any_value(ttf) AS ttf
      FROM r JOIN tt USING (win) WHERE ttf IS NOT NULL GROUP BY win)"""


def event_rows(spark, sf):
    return read_table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("value").alias("x"), "event_type")


def count_events(spark, sf):
    return event_rows(spark, sf).count()  # parquet footer


# folds over all events; the draws are modular arithmetic, which SQL repeats


def mix_sql(value: str, seed: int) -> str:
    v = f"(({value}) * 104729 + {seed * 7919 + 12345}) % 2147483647"
    steps = [f"SELECT id, {v} AS v0 FROM ids"]
    for i in range(3):
        steps.append(f"SELECT id, (w * w + w + 1) % 2147483647 AS v{i + 1} FROM (SELECT id, v{i} * 48271 % 2147483647 AS w FROM ({steps[-1]}))")
    return steps[-1]


def fragments_sql(k: int, frag: float, pad: int, seed: int) -> str:
    return f"""c AS (SELECT n, n // {k} AS test, greatest(1, CAST(floor((n // {k}) * CAST({frag} AS DOUBLE)) AS BIGINT)) AS fr FROM (SELECT count(*) AS n FROM events)),
ids AS (SELECT unnest(range({k} * fr)) AS id FROM c), mx AS ({mix_sql('id', seed)}),
fg AS (SELECT id // fr AS fold, id % fr AS fragment, {pad} + v3 % (n - 1 - greatest(1, test // fr) - {pad}) AS start, greatest(1, test // fr) AS len, n FROM mx, c),
frg AS (SELECT fold, fragment, start, least(start + len, n - 1) AS stop, greatest(start - {pad}, 0) AS p0,
        least(least(start + len, n - 1) + {pad}, n - 1) AS p1 FROM fg)"""


PARAMS = {"n_splits": 5, "fragmentation": 0.02, "pad": 7, "seed": 11}
FRG = fragments_sql(5, 0.02, 7, 11)
ROLES = f"""{FRG}, f AS (SELECT unnest(range(5)) AS fold),
roles AS (SELECT e.event_id AS pos, f.fold, CASE WHEN count(*) FILTER (e.event_id >= start AND e.event_id < stop) > 0 THEN 'test'
  WHEN count(start) > 0 THEN 'pad' ELSE 'train' END AS role
  FROM events e CROSS JOIN f LEFT JOIN frg ON frg.fold = f.fold AND e.event_id >= p0 AND e.event_id < p1 GROUP BY 1, 2)"""


@query("block_fragments", f"WITH {FRG} SELECT fold::INTEGER AS fold, fragment::BIGINT AS fragment, start, stop AS \"end\", p0 AS pad_start, p1 AS pad_end FROM frg")
def fragments(spark, sf):
    return FO.block_fragments(spark, count_events(spark, sf), **PARAMS)


@query("block_folds", f"WITH {ROLES} SELECT pos, fold::INTEGER AS fold, role FROM roles")
def block_folds(spark, sf):
    return FO.block_folds(event_rows(spark, sf), count_events(spark, sf), **PARAMS).select("pos", "fold", "role")


@query("block_folds_thrown_out", f"WITH {ROLES} SELECT fold::INTEGER AS fold, round(count(*) FILTER (role = 'pad') * 100.0::DOUBLE / count(*), 6) AS thrown_out FROM roles GROUP BY 1")
def thrown_out(spark, sf):
    n = count_events(spark, sf)
    out = FO.thrown_out(FO.block_folds(event_rows(spark, sf), n, **PARAMS), n)
    return out.select("fold", F.round("thrown_out", 6).alias("thrown_out"))


@query("fold_unused_rows", f"WITH {ROLES} SELECT fold::INTEGER AS fold, pos FROM roles WHERE role = 'pad'")
def unused(spark, sf):
    rows = event_rows(spark, sf)
    return FO.unused_rows(FO.block_folds(rows, count_events(spark, sf), **PARAMS), rows, 5)


@query("single_split", "SELECT event_id AS pos, role FROM events, (SELECT unnest(['train', 'test']) AS role)")
def single(spark, sf):
    return FO.block_folds(event_rows(spark, sf), 1, n_splits=1).select("pos", "role")


KF = """WITH n AS (SELECT count(*) AS n FROM events), f AS (SELECT unnest(range(7)) AS fold),
p AS (SELECT pos, CASE WHEN pos < (n % 7) * (n // 7 + 1) THEN pos // (n // 7 + 1) ELSE (pos - (n % 7) * (n // 7 + 1)) // (n // 7) + n % 7 END AS part FROM ({}), n)
SELECT {} fold::INTEGER AS fold, CASE WHEN part = fold THEN 'test' ELSE 'train' END AS role FROM p, f"""


@query("k_fold", KF.format("SELECT event_id AS pos FROM events", "pos,"))
def k_fold(spark, sf):
    return FO.k_fold(event_rows(spark, sf), count_events(spark, sf), 7).select("pos", "fold", "role")


SHUFFLED = f"""SELECT id, row_number() OVER (ORDER BY v3, id) - 1 AS pos FROM ({mix_sql('id', 4)})"""


@query("k_fold_shuffled", KF.replace("WITH n AS", "WITH ids AS (SELECT event_id AS id FROM events), n AS").replace("SELECT pos, CASE", "SELECT id, CASE")
       .format(SHUFFLED, "id AS pos,"))
def k_fold_shuffled(spark, sf):
    return FO.k_fold(event_rows(spark, sf), count_events(spark, sf), 7, shuffle=True, seed=4).select("pos", "fold", "role")


def repeated_sql(partition: str, part: str) -> str:
    """Roles of two shuffled three-fold splits; ``part`` is the part of a row from its ``rank`` (and ``n`` rows in all)."""
    one = f"""SELECT {{r}} AS r, id, row_number() OVER ({partition} ORDER BY v3, id) - 1 AS rank FROM ({{mixed}}) JOIN events ON event_id = id"""
    both = " UNION ALL ".join(one.format(r=r, mixed=mix_sql("id", r)) for r in range(2))
    return f"""WITH ids AS (SELECT event_id AS id FROM events), n AS (SELECT count(*) AS n FROM events), k AS ({both}),
p AS (SELECT r, id AS pos, {part} AS part FROM k, n), f AS (SELECT unnest(range(3)) AS f)
SELECT pos, (r * 3 + f)::INTEGER AS fold, CASE WHEN part = f THEN 'test' ELSE 'train' END AS role FROM p, f"""


@query("repeated_k_fold", repeated_sql("", "CASE WHEN rank < (n % 3) * (n // 3 + 1) THEN rank // (n // 3 + 1) ELSE (rank - (n % 3) * (n // 3 + 1)) // (n // 3) + n % 3 END"))
def repeated_k_fold(spark, sf):
    n = count_events(spark, sf)
    return FO.repeated(FO.k_fold, 2, 3, df=event_rows(spark, sf), n=n).select("pos", "fold", "role")


@query("stratified_k_fold", """WITH p AS (SELECT event_id AS pos, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 5 AS part FROM events)
SELECT pos, fold::INTEGER AS fold, CASE WHEN part = fold THEN 'test' ELSE 'train' END AS role FROM p, (SELECT unnest(range(5)) AS fold)""")
def stratified(spark, sf):
    return FO.stratified_k_fold(event_rows(spark, sf), "event_type", 5).select("pos", "fold", "role")


@query("repeated_stratified_k_fold", repeated_sql("PARTITION BY event_type", "rank % 3"))
def repeated_stratified(spark, sf):
    df = FO.repeated(functools.partial(FO.stratified_k_fold, label="event_type"), 2, 3, df=event_rows(spark, sf))
    return df.select("pos", "fold", "role")


FEW = fragments_sql(10, 0.1, 15, 0)


@query("block_folds_default", f"""WITH {FEW}, f AS (SELECT unnest(range(10)) AS fold),
test AS (SELECT DISTINCT fold, unnest(range(start, stop)) AS pos FROM frg), near AS (SELECT DISTINCT fold, unnest(range(p0, p1)) AS pos FROM frg)
SELECT e.event_id AS pos, f.fold::INTEGER AS fold, CASE WHEN test.pos IS NOT NULL THEN 'test' WHEN near.pos IS NOT NULL THEN 'pad' ELSE 'train' END AS role
FROM events e CROSS JOIN f LEFT JOIN test ON test.fold = f.fold AND test.pos = e.event_id LEFT JOIN near ON near.fold = f.fold AND near.pos = e.event_id""")
def block_folds_default(spark, sf):
    """A tenth of the rows per fold, in as many fragments as a tenth of those: many short ranges."""
    return FO.block_folds(event_rows(spark, sf), count_events(spark, sf)).select("pos", "fold", "role")


@query("random_slice", f"""WITH ids AS (SELECT 0::BIGINT AS id), d AS ({mix_sql('id', 3)}), b AS (SELECT v3 % (SELECT count(*) - 150 + 1 FROM events) AS begin FROM d)
SELECT event_id AS pos, value AS x FROM events, b WHERE event_id >= begin AND event_id < begin + 150""")
def sample(spark, sf):
    return random_slice(event_series(spark, sf), count_events(spark, sf), 150, seed=3).select("pos", "x")


@query("time_series_split", """WITH n AS (SELECT count(*) AS n, count(*) // 5 AS size FROM events),
p AS (SELECT event_id AS pos, fold, n - 4 * size + fold * size AS start, size FROM events, n, (SELECT unnest(range(4)) AS fold))
SELECT pos, fold::INTEGER AS fold, CASE WHEN pos < start THEN 'train' ELSE 'test' END AS role FROM p WHERE pos < start + size""")
def time_series(spark, sf):
    return FO.time_series_split(event_rows(spark, sf), count_events(spark, sf), 4).select("pos", "fold", "role")


# scalers
@query("standard_scaler", "SELECT event_id AS pos, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS x FROM events")
def standard(spark, sf):
    df = event_rows(spark, sf)
    return transform(df, ["x"], fit(df, ["x"])).select("pos", F.round("x", 6).alias("x"))


@query("min_max_scaler", "SELECT event_id AS pos, round((value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events), 7) AS x FROM events")
def min_max(spark, sf):
    df = event_rows(spark, sf)
    return transform(df, ["x"], fit(df, ["x"], "MinMaxScaler")).select("pos", F.round("x", 7).alias("x"))


@query("scaler_per_fold", f"""WITH {ROLES}, z AS (SELECT fold, pos, role, value AS x FROM roles JOIN events ON event_id = pos),
s AS (SELECT fold, avg(x) AS a, stddev_pop(x) AS b FROM z WHERE role = 'train' GROUP BY fold)
SELECT z.fold::INTEGER AS fold, pos, role, round((x - a) / b, 6) AS x FROM z JOIN s USING (fold)""")
def per_fold(spark, sf):
    folds = FO.block_folds(event_rows(spark, sf).select("pos", "x"), count_events(spark, sf), **PARAMS)
    return scale_folds(folds, ["x"]).select("fold", "pos", "role", F.round("x", 6).alias("x"))


# metrics: a moving-free toy prediction, the mean of the user's value
@query("metrics", """WITH p AS (SELECT event_type, value AS y, 40 + user_id % 20 AS p FROM events)
SELECT event_type, round(avg(abs(y - p)), 5) AS mean_absolute_error, round(avg((y - p) * (y - p)), 4) AS mean_squared_error,
median(abs(y - p)) AS median_absolute_error, max(abs(y - p)) AS max_error, round(1 - var_pop(y - p) / var_pop(y), 6) AS explained_variance_score,
round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2_score FROM p GROUP BY event_type""")
def metric_values(spark, sf):
    df = read_table(spark, sf, "events").select("event_type", F.col("value").alias("y"), (F.lit(40.0) + F.col("user_id") % 20).alias("prediction"))
    out = score(df, list(METRICS), ["event_type"])
    digits = {"mean_absolute_error": 5, "mean_squared_error": 4, "explained_variance_score": 6, "r2_score": 6}
    return out.select("event_type", *[F.round(m, digits[m]).alias(m) if m in digits else m for m in METRICS])


# models
KT = f"""{FTAB}, n AS (SELECT count(*) AS n FROM t), fo AS (SELECT unnest(range(3)) AS fold),
pt AS (SELECT t.*, CASE WHEN pos < (n % 3) * (n // 3 + 1) THEN pos // (n // 3 + 1) ELSE (pos - (n % 3) * (n // 3 + 1)) // (n // 3) + n % 3 END AS part FROM t, n),
fr AS (SELECT fold, pos, avg_x, ttf, CASE WHEN part = fold THEN 'test' ELSE 'train' END AS role FROM pt, fo),
lm AS (SELECT fold, regr_slope(ttf, avg_x) AS b, regr_intercept(ttf, avg_x) AS a FROM fr WHERE role = 'train' GROUP BY fold),
pr AS (SELECT fr.*, a + b * avg_x AS prediction FROM fr JOIN lm USING (fold))"""


def folded(spark, sf, k=3):
    df = written(features(spark, sf), "table")
    return FO.k_fold(df, df.count(), k)


@query("linear_regression_out_of_fold", f"WITH {KT} SELECT fold::INTEGER AS fold, role, pos, round(ttf, 6) AS y, round(prediction, 3) AS prediction FROM pr")
def linear(spark, sf):
    out = runs.out_of_fold(folded(spark, sf), ["avg_x"], "LinearRegression", {})
    return out.select("fold", "role", "pos", F.round("y", 6).alias("y"), F.round("prediction", 3).alias("prediction"))


@query("linear_regression_fold_scores", f"""WITH {KT} SELECT fold::INTEGER AS fold,
round(avg(abs(ttf - prediction)) FILTER (role = 'test'), 4) AS mean_absolute_error, round(avg(abs(ttf - prediction)) FILTER (role = 'train'), 4) AS mean_absolute_error_train,
round(avg((ttf - prediction) ** 2) FILTER (role = 'test'), 2) AS mean_squared_error, round(avg((ttf - prediction) ** 2) FILTER (role = 'train'), 2) AS mean_squared_error_train
FROM pr GROUP BY fold""")
def linear_scores(spark, sf):
    out = runs.fold_scores(runs.out_of_fold(folded(spark, sf), ["avg_x"], "LinearRegression", {}), ["mean_absolute_error", "mean_squared_error"])
    return out.select("fold", *[F.round(c, 4 if "absolute" in c else 2).alias(c) for c in out.columns[1:]])


@query("ridge_regression", f"""WITH {FTAB}, s AS (SELECT avg(avg_x) AS mx, stddev_pop(avg_x) AS sx, avg(ttf) AS my, count(*) AS n FROM t),
z AS (SELECT pos, (avg_x - mx) / sx AS z, ttf - my AS d, my FROM t, s), w AS (SELECT sum(z * d) / (sum(z * z) + 10.0::DOUBLE) AS w FROM z)
SELECT pos, round(my + w * z, 3) AS prediction FROM z, w""")
def ridge(spark, sf):
    df = features(spark, sf)
    z = runs.assemble_features(transform(df, ["avg_x"], fit(df, ["avg_x"])), ["avg_x"])
    return create_model("Ridge", {"alpha": 10.0}, z).fit(z).transform(z).select("pos", F.round("prediction", 3).alias("prediction"))


@query("lasso_regression", f"""WITH {FTAB}, s AS (SELECT avg(avg_x) AS mx, stddev_pop(avg_x) AS sx, avg(ttf) AS my, count(*) AS n FROM t),
z AS (SELECT pos, (avg_x - mx) / sx AS z, ttf - my AS d, my, n FROM t, s), c AS (SELECT sum(z * d) / any_value(n) AS c FROM z),
w AS (SELECT sign(c) * greatest(abs(c) - 1.0::DOUBLE, 0) AS w FROM c)
SELECT pos, round(my + w * z, 2) AS prediction FROM z, w""")
def lasso(spark, sf):
    df = features(spark, sf)
    z = runs.assemble_features(transform(df, ["avg_x"], fit(df, ["avg_x"])), ["avg_x"])
    return create_model("Lasso", {"alpha": 1.0}).fit(z).transform(z).select("pos", F.round("prediction", 2).alias("prediction"))


def model_query(name: str, model: str, params: dict):
    query(name)(lambda spark, sf: runs.out_of_fold(folded(spark, sf), COLS, model, params).filter("role = 'test'").select("fold", "pos", "y", "prediction"))


model_query("decision_tree", "DecisionTreeRegressor", {"max_depth": 4})
model_query("random_forest", "RandomForestRegressor", {"n_estimators": 10, "max_depth": 4})
model_query("extra_trees", "ExtraTreeRegressor", {"n_estimators": 10, "max_depth": 4})
model_query("gradient_boosting", "XGBRegressor", {"eta": 0.1, "max_depth": 3, "n_estimators": 5, "subsample": 0.95, "eval_metric": "mae", "nthread": 15})
model_query("ada_boost", "AdaBoostRegressor", {"n_estimators": 5})


STUMPS = {"eta": 0.5, "max_depth": 1, "n_estimators": 2, "gamma": 0.75, "min_child_weight": 5, "max_bins": 8, "objective": "reg:linear"}


def stump_sql(name: str, before: str) -> str:
    """``name``: the best cut of all features for the errors of the predictions ``before``, and the predictions ``name``p after it."""
    return f"""{name}g AS (SELECT fno, value, p - ttf AS g, cut FROM lf JOIN {before} USING (pos) JOIN cuts USING (fno)),
{name}c AS (SELECT fno, cut, coalesce(sum(g) FILTER (value < cut), 0) AS gl, (count(*) FILTER (value < cut))::DOUBLE AS hl, sum(g) AS gt, count(*)::DOUBLE AS ht FROM {name}g GROUP BY fno, cut),
{name} AS (SELECT *, (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) / 2 - 0.75::DOUBLE AS gain FROM {name}c WHERE hl >= 5 AND ht - hl >= 5
 ORDER BY gain DESC, fno, cut LIMIT 1),
{name}p AS (SELECT lf.pos, p - 0.5::DOUBLE * CASE WHEN gain <= 0 THEN gt / (ht + 1) WHEN value < cut THEN gl / (hl + 1) ELSE (gt - gl) / (ht - hl + 1) END AS p
 FROM {name} JOIN lf USING (fno) JOIN {before} ON {before}.pos = lf.pos)"""


@query("gradient_boosting_stumps", f"""WITH {FTAB},
lf AS (SELECT pos, fno, ttf, CASE fno WHEN 0 THEN avg_x WHEN 1 THEN std_x WHEN 2 THEN top ELSE slope END AS value FROM t, (SELECT unnest(range(4)) AS fno)),
cuts AS (SELECT DISTINCT fno, unnest(quantile_disc(value, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS cut FROM lf GROUP BY fno),
p0 AS (SELECT pos, (SELECT avg(ttf) FROM t) AS p FROM t), {stump_sql('a', 'p0')}, {stump_sql('b', 'ap')}
SELECT pos, round(p, 4) AS prediction FROM bp""")
def stumps(spark, sf):
    """Two rounds of second-order stumps with gamma, over all windows."""
    z = runs.assemble_features(written(features(spark, sf), "table"), COLS)
    return create_model("XGBRegressor", STUMPS).fit(z).transform(z).select("pos", F.round("prediction", 4).alias("prediction"))


@query("binned_label_classifier")
def classifier(spark, sf):
    df = features(spark, sf).withColumn("bin", F.least(F.floor(F.col("ttf") / 100), F.lit(15)).cast("double"))
    z = written(runs.assemble_features(transform(df, COLS, fit(df, COLS)), COLS), "table")
    model = binned_classifier(len(COLS), [8], max_iter=20).fit(z)
    return model.transform(z).select("pos", (class_centre() * 100).alias("prediction"))


@query("ensemble_mean", f"""WITH {FTAB}, a AS (SELECT regr_slope(ttf, avg_x) AS b, regr_intercept(ttf, avg_x) AS a FROM t),
c AS (SELECT regr_slope(ttf, top) AS b, regr_intercept(ttf, top) AS a FROM t)
SELECT pos, round((a.a + a.b * avg_x + c.a + c.b * top) / 2, 3) AS prediction FROM t, a, c""")
def ensemble(spark, sf):
    out = written(features(spark, sf), "table")
    for i, col in enumerate(("avg_x", "top")):
        z = runs.assemble_features(out, [col])
        out = create_model("LinearRegression", {}).fit(z).transform(z).withColumnRenamed("prediction", f"p{i}").drop("features", "y")
    return out.select("pos", F.round(ensemble_mean(["p0", "p1"]), 3).alias("prediction"))


@query("latest_predictions", f"""WITH {ROLES} SELECT pos, round(arg_max(value, fold), 6) AS y, max(fold)::DOUBLE AS yhat
FROM roles JOIN events ON event_id = pos WHERE role = 'test' GROUP BY pos""")
def latest(spark, sf):
    folds = FO.block_folds(event_rows(spark, sf), count_events(spark, sf), **PARAMS).filter("role = 'test'")
    out = latest_predictions(folds.select("pos", "fold", F.col("x").alias("y"), F.col("fold").cast("double").alias("yhat")))
    return out.select("pos", F.round("y", 6).alias("y"), "yhat")


def table_folds_sql(name: str, repeat: int = 0) -> str:
    """``name(fold, pos, role, avg_x, ttf)``: block folds (3 splits, one fragment, 2 rows of padding) of the feature table ``t``."""
    return f"""{name}_n AS (SELECT count(*) AS n, count(*) // 3 AS len FROM t), {name}_ids AS (SELECT id FROM (SELECT unnest(range(3)) AS id)),
{name}_f AS (SELECT id AS fold, 2 + v3 % (n - 1 - len - 2) AS start, len, n FROM ({mix_sql(f'id + {repeat} * 1000003', 0).replace('FROM ids', f'FROM {name}_ids')}), {name}_n),
{name}_r AS (SELECT fold, start, least(start + len, n - 1) AS stop, greatest(start - 2, 0) AS p0, least(least(start + len, n - 1) + 2, n - 1) AS p1 FROM {name}_f),
{name} AS (SELECT fold, pos, avg_x, ttf, CASE WHEN pos >= start AND pos < stop THEN 'test' WHEN pos >= p0 AND pos < p1 THEN 'pad' ELSE 'train' END AS role FROM t, {name}_r)"""


def ridge_sql(rows: str, name: str, alpha: float) -> str:
    """``name(fold, role, ttf, prediction)``: one feature, scaled by the training rows, with a penalty (0: none)."""
    return f"""{name}_s AS (SELECT fold, avg(avg_x) AS mx, stddev_pop(avg_x) AS sx, avg(ttf) AS my, count(*) AS n, covar_pop(avg_x, ttf) * count(*) AS sxy
FROM {rows} WHERE role = 'train' GROUP BY fold),
{name} AS (SELECT fold, role, ttf, my + sxy / sx / (n + {alpha}::DOUBLE) * (avg_x - mx) / sx AS prediction FROM {rows} JOIN {name}_s USING (fold) WHERE role <> 'pad')"""


def scores_sql(name: str) -> str:
    part = lambda e, role: f"avg({e}) FILTER (role = '{role}')"
    mae, mse = "abs(ttf - prediction)", "(ttf - prediction) ** 2"
    return f"""round({part(mae, 'test')}, 4) AS mean_absolute_error, round({part(mae, 'train')}, 4) AS mean_absolute_error_train,
round({part(mse, 'test')}, 2) AS mean_squared_error, round({part(mse, 'train')}, 2) AS mean_squared_error_train FROM {name} GROUP BY fold"""


GRID_SQL = f"""WITH {FTAB}, {table_folds_sql('cf')}, tn AS (SELECT count(*) AS n, count(*) // 3 AS size FROM t),
ts AS (SELECT fold, pos, avg_x, ttf, CASE WHEN pos < n - 2 * size + fold * size THEN 'train' ELSE 'test' END AS role FROM t, tn, (SELECT unnest(range(2)) AS fold)
  WHERE pos < n - 2 * size + (fold + 1) * size),
{', '.join(ridge_sql(f, f'{f}_{m}', a) for f in ('cf', 'ts') for m, a in (('lin', 0.0), ('rid', 10.0)))}
""" + " UNION ALL ".join(f"SELECT '{folds}' AS folds_name, '{model}' AS model_name, '{params}' AS model_params, fold::INTEGER AS fold, {scores_sql(f'{f}_{m}')}"
                         for f, folds in (("cf", "CustomFold"), ("ts", "TimeSeriesSplit"))
                         for m, model, params in (("lin", "LinearRegression", "{}"), ("rid", "Ridge", '{"alpha": 10.0}')))


def rounded_scores(df, *keys):
    return df.select(*keys, *[F.round(c, 4 if "absolute" in c else 2).alias(c) for c in df.columns if c.startswith("mean_")])


@query("run_grid", GRID_SQL)
def grid(spark, sf):
    df = written(features(spark, sf), "table")
    n = df.count()
    tables = {"CustomFold": FO.block_folds(df, n, 3, 0.0, 2), "TimeSeriesSplit": FO.time_series_split(df, n, 2)}
    models = [("LinearRegression", {}), ("Ridge", {"alpha": 10.0})]
    out = runs.run_grid(tables, ["avg_x"], models, ["mean_absolute_error", "mean_squared_error"])
    return rounded_scores(out, "folds_name", "model_name", "model_params", "fold")


@query("repeated_validation_score", f"""WITH {FTAB}, {table_folds_sql('r0', 0)}, {table_folds_sql('r1', 1)}, {ridge_sql('r0', 'p0', 0.0)}, {ridge_sql('r1', 'p1', 0.0)},
s AS (SELECT {scores_sql('p0')} UNION ALL SELECT {scores_sql('p1')})
SELECT round(avg(mean_absolute_error), 2) AS mean_absolute_error_mean, round(stddev_pop(mean_absolute_error), 2) AS mean_absolute_error_std FROM s""")
def repeated_score(spark, sf):
    df = written(features(spark, sf), "table")
    n = df.count()
    parts = [runs.fold_scores(runs.out_of_fold(FO.block_folds(df, n, 3, 0.0, 2, seed=0, repeat=r), ["avg_x"], "LinearRegression", {}),
                              ["mean_absolute_error"]) for r in range(2)]
    out = score_summary(parts[0].unionByName(parts[1]), ["mean_absolute_error"])
    return out.select(*[F.round(c, 2).alias(c) for c in out.columns])


ALPHAS = [0.0, 1.0, 10.0, 100.0]


@query("ridge_search", f"""WITH {KT}, {', '.join(ridge_sql('fr', f'ra{i}', a) for i, a in enumerate(ALPHAS))},
s AS ({' UNION ALL '.join(f"SELECT {a}::DOUBLE AS alpha, fold, avg(abs(ttf - prediction)) AS e, avg((ttf - prediction) ** 2) AS q FROM ra{i} WHERE role = 'test' GROUP BY fold" for i, a in enumerate(ALPHAS))})
SELECT alpha, round(avg(e), 3) AS mean_absolute_error_mean, round(stddev_pop(e), 3) AS mean_absolute_error_std, round(avg(q), 1) AS mean_squared_error_mean, round(stddev_pop(q), 1) AS mean_squared_error_std
FROM s GROUP BY alpha""")
def ridge_search(spark, sf):
    """Four penalties over three folds: one pass for the moments, one for the errors."""
    out = runs.ridge_search(folded(spark, sf), ["avg_x"], ALPHAS, ["mean_absolute_error", "mean_squared_error"])
    return out.select("alpha", *[F.round(c, 3 if "absolute" in c else 1).alias(c) for c in out.columns[1:]])


@query("successive_halving")
def halving(spark, sf):
    """Boosted trees drawn at random; a third of them gets more trees."""
    folds = runs.prepared_folds(folded(spark, sf, 2), COLS)

    def loss(params, budget):
        scores = runs.fold_scores(runs.fold_predictions(folds, "XGBRegressor", {**params, "n_estimators": budget}), ["mean_absolute_error"])
        return scores.agg(F.avg("mean_absolute_error")).first()[0]

    space = {"eta": [0.1, 0.3, 0.9], "max_depth": [1, 2], "gamma": [0.0, 0.75]}
    rows = [(i, float(v), b, str(sorted(p.items()))) for i, (v, b, p) in enumerate(runs.successive_halving(space, 3, loss, [1, 3]))]
    return spark.createDataFrame(rows, "place int, loss double, trees int, params string")


@query("random_search")
def search(spark, sf):
    folds = runs.prepared_folds(folded(spark, sf, 2), COLS)

    def loss(params):
        scores = runs.fold_scores(runs.fold_predictions(folds, "XGBRegressor", params), ["mean_absolute_error"])
        return scores.agg(F.avg("mean_absolute_error")).first()[0]

    space = {"eta": [0.05, 0.1, 0.2], "max_depth": [2, 3], "n_estimators": [2, 3], "subsample": [0.8, 1.0]}
    rows = [(i, float(v), str(sorted(p.items()))) for i, (v, p) in enumerate(runs.random_search(space, 2, loss))]
    return spark.createDataFrame(rows, "place int, loss double, params string")


def summaries(spark, sf):
    path = scratch(spark, "summary")
    folds = folded(spark, sf)
    for model, params in (("LinearRegression", {}), ("Ridge", {"alpha": 10.0})):
        scores = runs.fold_scores(runs.out_of_fold(folds, ["avg_x"], model, params), ["mean_absolute_error"])
        append_summary(runs.summary_row(scores, ["mean_absolute_error"], "events", ("KFold", {"n_splits": 3}), (model, params),
                                        ("StandardScaler", {})), path)
    return read_summary(spark, path)


SUMMARY_SQL = f"""WITH {KT}, {ridge_sql('fr', 'rd', 10.0)}, s AS (SELECT 'LinearRegression' AS model_name, NULL::VARCHAR AS model_params, fold, {scores_sql('pr')}
UNION ALL SELECT 'Ridge', '{{{{"alpha":"10.0"}}}}', fold, {scores_sql('rd')})
SELECT model_name, any_value(model_params) AS model_params, 'KFold' AS folds_name, array_to_string(list(mean_absolute_error ORDER BY fold), ' ') AS mean_absolute_error,
array_to_string(list(mean_absolute_error_train ORDER BY fold), ' ') AS mean_absolute_error_train FROM s GROUP BY model_name""".replace("{{", "{").replace("}}", "}")


@query("run_summary", SUMMARY_SQL)
def summary(spark, sf):
    text = lambda c: F.array_join(F.transform(c, lambda v: F.round(v, 4).cast("string")), " ").alias(c)
    return summaries(spark, sf).select("model_name", F.to_json("model_params").alias("model_params"), "folds_name", text("mean_absolute_error"),
                                       text("mean_absolute_error_train"))


@query("summary_to_config", """SELECT '[''mean_absolute_error'', ''mean_absolute_error_train'']' AS metrics, '[{''name'': ''KFold'', ''n_splits'': 3}]' AS folds,
'[{''model'': {''LinearRegression'': {}}}, {''model'': {''Ridge'': {''alpha'': 10.0}}}]' AS validate""")
def config(spark, sf):
    made = runs.summary_to_config(summaries(spark, sf), [0, 1], ["model_name"])
    return spark.createDataFrame([(str(made["metrics"]), str(made["folds"]), str(made["validate"]))], "metrics string, folds string, validate string")


SEGMENTS = f"""WITH {USERS}, c AS (SELECT series_id, count(*) AS n FROM u GROUP BY 1 HAVING count(*) >= 40),
k AS (SELECT series_id, n, unnest(range(CAST(ceil((n - 40 + 15) / 15.0) AS BIGINT))) AS win FROM c),
f AS (SELECT u.series_id, win, avg(x) AS m, arg_max(x, pos) AS ttf FROM k JOIN u ON u.series_id = k.series_id AND pos >= win * 15 AND pos < win * 15 + 40 GROUP BY 1, 2),
l AS (SELECT regr_slope(ttf, m) AS b, regr_intercept(ttf, m) AS a FROM f)
SELECT series_id AS seg_id, round(arg_max(a + b * m, win), 4) AS time_to_failure FROM f, l GROUP BY series_id"""


@query("score_segments", SEGMENTS)
def segments(spark, sf):
    """Train on all windows of all users, save and reload the model, predict each user's last window, write the submission."""
    table = written(window_features(user_series(spark, sf), {"m": ("w_mean", {}), "ttf": ("w_last_elem", {})}, 40, 15, short="drop"), "table")
    path = scratch(spark, "model")
    runs.fit_pipeline(table, ["m"], "LinearRegression", {}).save(path)
    scored = runs.score_segments(table, PipelineModel.load(path))
    target = scratch(spark, "submission")
    write_submission(scored, target)
    back = spark.read.csv(target, header=True, schema="seg_id string, time_to_failure double")
    return back.select("seg_id", F.round("time_to_failure", 4).alias("time_to_failure"))


@query("score_segments_undefined", SEGMENTS.replace("f AS (SELECT u.series_id, win, avg(x) AS m", "g AS (SELECT u.series_id, win, CASE WHEN win % 2 = 0 THEN avg(x) END AS d")
       .replace("l AS (SELECT regr_slope", "f AS (SELECT series_id, win, coalesce(d, (SELECT avg(d) FROM g)) AS m, ttf FROM g), l AS (SELECT regr_slope"))
def segments_undefined(spark, sf):
    """Every second window has an undefined feature, many last ones among them: each segment still gets its last window's prediction."""
    table = window_features(user_series(spark, sf), {"m": ("w_mean", {}), "ttf": ("w_last_elem", {})}, 40, 15, short="drop")
    table = written(table.withColumn("m", F.when(F.col("win") % 2 == 0, F.col("m"))), "table")
    scored = runs.score_segments(table, runs.fit_pipeline(table, ["m"], "LinearRegression", {}, fill="mean"))
    return scored.select("seg_id", F.round("time_to_failure", 4).alias("time_to_failure"))


@query("own_model", f"WITH {FTAB} SELECT pos, round((SELECT median(ttf) FROM t), 6) AS prediction FROM t")
def own_model(spark, sf):
    """A registered model of one's own: the median of the label."""

    class Median:
        def fit(self, df):
            self.value = exact_quantiles(df.select(F.lit(0).alias("k"), "y"), ["k"], "y", {"m": 0.5}).first()["m"]  # no task holds all labels
            return self

        def transform(self, df):
            return df.withColumn("prediction", F.lit(self.value))

    register_model("Median", Median)
    z = runs.assemble_features(written(features(spark, sf), "table"), ["avg_x"])
    return create_model("Median", {}).fit(z).transform(z).select("pos", F.round("prediction", 6).alias("prediction"))
