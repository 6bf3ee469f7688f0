import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe.models import folds as FO
from strideframe.models import runs, scaling, selection
from strideframe.models.estimators import create_model
from strideframe.operators.information import normalized_mutual_information
from strideframe.operators.windows import register_aggregate, register_kernel, window_features
from strideframe.series import series
from strideframe.plans.features import build_feature, build_features, enabled, feature_grid, smooth_columns, truncated_name, widen
from tests import brute

rng = np.random.default_rng(5)
X = np.round(rng.gamma(2, 3, 900), 2)


@pytest.fixture(scope="module")
def s(spark):
    pdf = pd.DataFrame({"series_id": "a", "pos": np.arange(900), "x": X, "ttf": np.arange(900)[::-1] / 10.0})
    return spark.createDataFrame(pdf, "series_id string, pos bigint, x double, ttf double").repartition(3).persist()


def test_spec_rules():
    chains = enabled([{"name": "a", "on": True, "functions": {"r_std": {"window_stride": None}, "w_mean": {}}},
                      {"name": "a", "on": True, "functions": {"w_mean": {"window_size": 7}}},
                      {"name": "off", "on": False, "functions": {"w_mean": {}}}], 100, 10)
    assert list(chains) == ["a", "a_2"]
    assert chains["a"] == [("r_std", {"window_size": 100}), ("w_mean", {"window_size": 100, "window_stride": 10})]
    assert chains["a_2"][0][1] == {"window_size": 7, "window_stride": 10}
    with pytest.raises(KeyError):
        enabled([{"name": "a", "functions": {"w_nothing": {}}}], 100, 10)
    assert len(feature_grid()) == 180 and len({f["name"] for f in feature_grid()}) == 180
    assert truncated_name("x" * 300) == "x" * 250 + ".." and truncated_name("") == ""


def test_feature_table(s):
    spec = [{"name": "q", "functions": {"r_std": {"window_size": 20}, "w_quantile": {"q": 0.05}}},
            {"name": "m", "functions": {"w_mean": {}}},
            {"name": "wide", "functions": {"w_max": {"window_size": 200, "window_stride": 100}}},
            {"name": "twice", "functions": [("w_mean", {}), ("r_clip", {"q_low": 0.2, "q_high": 0.8})]},
            {"name": "rows", "functions": {"r_mean": {"window_size": 5}}}]
    got = build_features(s, spec, 90, 40).orderBy("win").toPandas()
    starts = brute.starts(900, 90, 40)
    std = pd.Series(X).rolling(20, min_periods=1).std(ddof=0).values
    means = np.array([X[i:i + 90].mean() for i in starts])
    n = len(starts)
    np.testing.assert_allclose(got.q, [np.quantile(std[i:i + 90], .05) for i in starts])
    np.testing.assert_allclose(got.m, means)
    np.testing.assert_allclose(got.twice, np.clip(means, *np.quantile(means, [.2, .8])))
    wide = [X[i:i + 200].max() for i in brute.starts(900, 200, 100)]
    np.testing.assert_allclose(got.wide, np.interp(np.linspace(0, len(wide) - 1, n), np.arange(len(wide)), wide))
    roll = pd.Series(X).rolling(5, min_periods=1).mean().values
    np.testing.assert_allclose(got.rows, np.interp(np.linspace(0, 899, n), np.arange(900), roll))
    np.testing.assert_allclose(got.ttf, [(899 - (min(i + 90, 900) - 1)) / 10 for i in starts])
    assert list(got.columns) == ["series_id", "win", "q", "m", "wide", "twice", "rows", "ttf"]
    one = build_feature(s, spec, "wide", 90, 40).orderBy("win").toPandas()
    np.testing.assert_allclose(one.wide, wide)


def test_wide_arrays_and_smoothing(s):
    df = widen(build_features(s.drop("ttf"), [{"name": "p", "functions": {"w_psd": {"fs": 1.0}}}], 8, 8), "p", 5)
    assert df.columns == ["series_id", "win"] + [f"p_{i}" for i in range(5)]
    table = window_features(s, {"m": ("w_mean", {})}, 30, 10)
    got = smooth_columns(table, ["m"], 5, 1).orderBy("win").toPandas().m
    means = np.array([X[i:i + 30].mean() for i in brute.starts(900, 30, 10)])
    np.testing.assert_allclose(got[2:-2], np.convolve(means, np.full(5, .2), "valid"))


def test_own_operators(s):
    from strideframe.operators.kernels import KERNELS
    from strideframe.operators.panes import PANE_OPS, STATS, PaneOp
    register_aggregate("w_span", lambda: PaneOp({k: STATS[k] for k in ("n", "min", "max")}, "max - min"))
    register_kernel("w_third", "double", lambda w: w.kth([2])[:, 0])
    try:
        got = window_features(s, {"span": ("w_span", {}), "third": ("w_third", {})}, 100, 50).orderBy("win").toPandas()
    finally:
        PANE_OPS.pop("w_span")
        KERNELS.pop("w_third")
    starts = brute.starts(900, 100, 50)
    np.testing.assert_allclose(got.span, [np.ptp(X[i:i + 100]) for i in starts])
    np.testing.assert_allclose(got.third, [np.sort(X[i:i + 100])[2] for i in starts])


def test_block_folds(spark):
    n = 500
    df = spark.range(n).withColumnRenamed("id", "pos")
    for frag, pad in ((0.0, 7), (0.2, 3), (1.0, 1)):
        fr = FO.block_fragments(spark, n, 4, frag, pad, seed=9).toPandas()
        got = FO.block_folds(df, n, 4, frag, pad, seed=9).toPandas()
        assert (fr.start >= pad).all() and (fr.start < n - 1).all()
        for k in range(4):
            test, near = set(), set()
            for r in fr[fr.fold == k].itertuples():
                test |= set(range(r.start, min(r.end, n - 1)))
                near |= set(range(max(r.start - pad, 0), min(r.end + pad, n - 1)))
            part = got[got.fold == k]
            assert set(part[part.role == "test"].pos) == test
            assert set(part[part.role == "train"].pos) == set(range(n)) - near
            assert len(part) == n
    with pytest.raises(ValueError):
        FO.block_fragments(spark, n, 4.0)
    assert FO.block_folds(df, n, 1).groupBy("role").count().count() == 2
    assert FO.block_folds(df, n, 1, empty_test="skip").filter("role = 'test'").count() == 0


def test_other_folds(spark):
    df = spark.range(53).selectExpr("id as pos", "id % 3 as label")
    for part in (FO.k_fold(df, 53, 5), FO.k_fold(df, 53, 5, shuffle=True), FO.stratified_k_fold(df, "label", 5), FO.stratified_k_fold(df, "label", 5, True)):
        got = part.toPandas()
        test = got[got.role == "test"]
        assert sorted(test.pos) == list(range(53)) and len(got) == 5 * 53
        assert test.groupby("fold").size().between(9, 12).all()
    got = FO.time_series_split(df, 53, 4).toPandas()
    for k in range(4):
        start = 53 - 4 * 10 + k * 10
        assert sorted(got[(got.fold == k) & (got.role == "test")].pos) == list(range(start, start + 10))
        assert sorted(got[(got.fold == k) & (got.role == "train")].pos) == list(range(start))


def test_scalers(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (0, 3.0, 5.0), (1, 10.0, 1.0), (1, 14.0, 2.0)], "k int, a double, b double")
    got = scaling.transform(df, ["a", "b"], scaling.fit(df, ["a", "b"], keys=["k"]), ["k"]).orderBy("k", "a").toPandas()
    assert list(got.a) == [-1, 1, -1, 1] and list(got.b) == [0, 0, -1, 1]


def table(spark, n=120):
    x = rng.normal(size=(n, 4))
    y = 3 * x[:, 0] - 2 * x[:, 1] + rng.normal(size=n) * 0.1
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf["ttf"], pdf["pos"] = y, np.arange(n)
    return spark.createDataFrame(pdf), x, y


def test_linear_models(spark):
    df, x, y = table(spark)
    data = runs.assemble_features(df, list("abcd"))
    for alpha in (0.0, 25.0):
        name, params = ("Ridge", {"alpha": alpha}) if alpha else ("LinearRegression", {})
        got = create_model(name, params, data).fit(data).coefficients.toArray()
        d = x - x.mean(0)
        np.testing.assert_allclose(got, np.linalg.solve(d.T @ d + alpha * np.eye(4), d.T @ (y - y.mean())), rtol=1e-6, atol=1e-8)
    with pytest.raises(KeyError):
        create_model("NoSuchModel", {})


def test_selection(spark):
    df, _, _ = table(spark)
    cols = list("abcd")
    assert set(selection.recursive_elimination(df, cols, "ttf", 2, "LinearRegression")[0]) == {"a", "b"}
    assert selection.lasso_selection(df, cols, "ttf", 0.7) == ["a", "b"]
    assert selection.importance_selection(df, cols, "ttf", params={"n_estimators": 10})[:1] == ["a"]
    assert selection.univariate_selection(df, cols, "ttf", "numTopFeatures", 2) == ["a", "b"]
    out = selection.two_stage_elimination(df.drop("pos"), "ttf", 75, 2, "LinearRegression", bins=6)
    assert set(out.columns) == {"a", "b"}
    with pytest.raises(ValueError):
        selection.two_stage_elimination(df, "ttf", 10, 3)


def test_normalised_information_limits(spark):
    df = spark.createDataFrame([("same", 1, 1), ("same", 2, 2), ("const", 1, 1), ("const", 1, 1), ("none", 1, 1), ("none", 1, 2), ("none", 2, 1), ("none", 2, 2)],
                               "k string, a int, b int")
    got = {r.k: r.nmi for r in normalized_mutual_information(df, ["k"], "a", "b").collect()}
    assert got["same"] == pytest.approx(1) and got["const"] == 1 and got["none"] == 0


def test_run_and_summary(spark):
    df, _, _ = table(spark)
    folds = FO.k_fold(df, 120, 3)
    scores = runs.fold_scores(runs.out_of_fold(folds, list("abcd"), "LinearRegression", {}), ["mean_absolute_error"])
    row = runs.summary_row(scores, ["mean_absolute_error"], "t", ("KFold", {"n_splits": 3}), ("LinearRegression", {}), ("StandardScaler", {}))
    first = row.first()
    assert len(first.mean_absolute_error) == 3 and first.folds_params == {"n_splits": "3"}
    config = runs.summary_to_config(row.unionByName(row), [0, 1], ["model_name"])
    assert config["folds"] == [{"name": "KFold", "n_splits": 3}] and len(config["validate"]) == 1
    assert config["metrics"] == ["mean_absolute_error", "mean_absolute_error_train"]
    with pytest.raises(ValueError):
        runs.summary_to_config(row.unionByName(row.withColumn("data_fname", F.lit("u"))), [0, 1], ["data_fname"])


@pytest.mark.parametrize("constant", [False, True], ids=["several", "one"])
def test_frame_path_shuffles_rows_once(spark, tmp_path, constant):
    spark.range(1000).selectExpr("id as pos", "id % 7 / 2 as x", "'s' || id % 2 as sid").write.parquet(str(tmp_path / "s"))
    rows = spark.read.parquet(str(tmp_path / "s"))
    s = series(rows, "pos", "x", None if constant else "sid")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    p = plan(window_features(s, {"m": ("w_mean", {}), "c": ("w_c3", {"lag": 3})}, 100, 20, rows=[("r_std", {"window_size": 10})]))
    assert p.count("Exchange hashpartitioning") == 1 and p.count("Sort [") <= 5
    p = plan(window_features(s, {"q": ("w_quantile", {})}, 100, 20, rows=[("r_std", {"window_size": 10}), ("r_mean", {"window_size": 3})]))
    assert p.count("Exchange hashpartitioning") == 1
    p = plan(window_features(s, {"m": ("w_mean", {}), "k": ("w_kurtosis", {})}, 100, 20))
    assert p.count("Exchange hashpartitioning") == 2 and "SortAggregate" not in p  # panes, then blocks of panes


def test_boosting_by_weights(spark):
    """The rounds against a plain definition: weighted stumps, linear loss, weighted median."""
    from strideframe.models.estimators import AdaBoostR2

    x = np.arange(60.0)
    y = np.where(x < 13, 1.0, np.where(x < 37, 4.0, 9.0)) + (x % 5) / 10
    df = runs.assemble_features(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, ttf double"), ["x"])
    model = AdaBoostR2(4, 1.0, 1, 0).fit(df)

    def stump(w):
        best = None
        for cut in range(1, 60):
            a, b = np.average(y[:cut], weights=w[:cut]), np.average(y[cut:], weights=w[cut:])
            p = np.where(x < cut, a, b)
            loss = (w * (y - p) ** 2).sum()
            if best is None or loss < best[0] - 1e-9:
                best = loss, p
        return best[1]

    w, parts, votes = np.full(60, 1 / 60), [], []
    for _ in range(len(model.trees)):
        p = stump(w)
        e = np.abs(y - p) / np.abs(y - p).max()
        loss = (w * e).sum() / w.sum()
        beta = loss / (1 - loss)
        parts.append(p)
        votes.append(np.log(1 / beta))
        w = w * beta ** (1 - e)
        w /= w.sum()
    np.testing.assert_allclose(model.votes, votes, rtol=1e-6)
    got = np.array([r.prediction for r in model.transform(df).orderBy("x").collect()])
    order = np.argsort(parts, axis=0)
    total = np.cumsum(np.array(model.votes)[order], axis=0)
    first = (total >= sum(model.votes) / 2).argmax(0)
    want = np.array(parts)[order[first, np.arange(60)], np.arange(60)]
    np.testing.assert_allclose(got, want, rtol=1e-6)


def test_unknown_parameters_are_errors():
    with pytest.raises(TypeError):
        create_model("XGBRegressor", {"num_leaves_": 3})
    model = create_model("XGBRegressor", {"eta": 0.2, "nthread": 4, "colsample_bytree": 0.5, "gamma": 0.75, "min_child_weight": 2.5, "objective": "gpu:reg:linear", "eval_metric": "mae"})
    assert (model.eta, model.colsample_bytree, model.gamma, model.min_child_weight, model.absolute, model.reg_lambda) == (0.2, 0.5, 0.75, 2.5, False, 1.0)
    assert create_model("LGBMRegressor", {"learning_rate": 0.3, "objective": "regression_l1"}).absolute
    with pytest.raises(TypeError):
        create_model("XGBRegressor", {"objective": "rank:pairwise"})


def test_own_models_are_found_by_name(spark):
    from strideframe.models.estimators import MODELS, register_model

    class Constant:
        def fit(self, df):
            return self

        def transform(self, df):
            return df.withColumn("prediction", F.lit(7.0))

    register_model("Constant", Constant)
    try:
        df, _, _ = table(spark)
        out = runs.out_of_fold(FO.k_fold(df, 120, 3), list("abcd"), "Constant", {})
        assert {r.prediction for r in out.collect()} == {7.0}
    finally:
        MODELS.pop("Constant")


def test_undefined_features_are_not_dropped(spark):
    df, _, _ = table(spark)
    holes = df.withColumn("a", F.when(F.col("pos") % 3 > 0, F.col("a"))).withColumn("series_id", F.col("pos").cast("string")).withColumn("win", F.lit(0))
    with pytest.raises(Exception):
        runs.assemble_features(holes, list("abcd")).collect()
    model = runs.fit_pipeline(holes, list("abcd"), "LinearRegression", {}, fill="mean")
    assert runs.score_segments(holes, model).filter("time_to_failure is not null").count() == 120


def test_folds_compare_no_pairs(spark):
    """Many short fragments: the plan looks positions up, and has no range condition."""
    df = spark.range(4000).withColumnRenamed("id", "pos")
    plan = FO.block_folds(df, 4000)._jdf.queryExecution().optimizedPlan().toString()
    join = plan.split("Join")[1].split("\n")[0]
    assert "_blk" in join and ">=" not in join and "<" not in join and plan.count("Join") == 1


def test_config_file_keeps_types(spark, tmp_path):
    config = {"folds": [{"name": "CustomFold", "n_splits": 3, "fragmentation": 0.5}], "preproc": {"name": "StandardScaler"}}
    runs.write_config(spark, config, str(tmp_path / "config.json"))
    assert runs.read_config(spark, str(tmp_path / "config.json")) == config


def test_savgol_sweep_is_registered(spark):
    from catalog.selection import sweep_savgol

    out = sweep_savgol(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.param for r in out) == [3, 13, 53] and all(r.mi >= 0 for r in out)
