"""Boosted trees, extra trees, linear models from moments, and fold roles, against plain definitions."""

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from strideframe.models import folds as FO
from strideframe.models import moments, runs, selection
from strideframe.models.boosting import Boosted, ExtraTrees, Trees, uniform
from strideframe.models.estimators import create_model

rng = np.random.default_rng(12)
N, COLS = 300, ["a", "b", "c"]
A = np.column_stack([rng.normal(size=N), rng.integers(0, 6, N), rng.normal(size=N).round(1)])
Y = np.where(A[:, 0] > 0.3, 4.0, 1.0) * (1 + A[:, 1]) + A[:, 2] + rng.normal(scale=0.2, size=N)


def table(spark, a=A, y=Y):
    return spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(a, y))], "pos bigint, a double, b double, c double, ttf double").repartition(3)


@pytest.fixture(scope="module")
def rows(spark):
    return runs.assemble_features(table(spark), COLS)


def quantiles(x, bins):
    """The smallest value that a share of the values does not exceed."""
    ordered = np.sort(x)
    return np.unique([ordered[max(0, int(np.ceil(i / bins * len(x) - 1e-12)) - 1)] for i in range(1, bins)])


def plain_boosting(a, y, eta, depth, rounds, mcw, gamma, lam, bins, absolute=False, keep=None, columns=None, base=None):
    """Trees node by node; returns the predictions of the rows."""
    cuts = [quantiles(x, bins) for x in a.T]
    p = np.full(len(y), y.mean() if base is None else base)
    for turn in range(rounds):
        g = np.sign(p - y) if absolute else p - y
        step = np.zeros(len(y))
        used = keep(turn) if keep else np.ones(len(y), bool)

        def grow(at, level):
            own = at & used
            G, H = g[own].sum(), own.sum()
            best = None
            if level < depth:
                for j in columns(turn) if columns else range(a.shape[1]):
                    for cut in cuts[j]:
                        left = own & (a[:, j] < cut)
                        gl, hl = g[left].sum(), left.sum()
                        if hl < max(mcw, 1) or H - hl < max(mcw, 1):
                            continue
                        gain = (gl ** 2 / (hl + lam) + (G - gl) ** 2 / (H - hl + lam) - G ** 2 / (H + lam)) / 2 - gamma
                        if best is None or gain > best[0] + 1e-9:
                            best = gain, j, cut
            if best and best[0] > 0:
                grow(at & (a[:, best[1]] < best[2]), level + 1)
                grow(at & (a[:, best[1]] >= best[2]), level + 1)
            elif H:
                step[at] = -eta * G / (H + lam)

        grow(np.ones(len(y), bool), 0)
        p = p + step
    return p


def by_pos(df, column="prediction"):
    return np.array([r[0] for r in df.orderBy("pos").select(column).collect()])


@pytest.mark.parametrize("params", [{"eta": 0.3, "max_depth": 3, "n_estimators": 4, "gamma": 0.75, "min_child_weight": 10, "max_bins": 16},
                                    {"eta": 0.5, "max_depth": 2, "n_estimators": 3, "reg_lambda": 0.0, "max_bins": 64},
                                    {"eta": 0.5, "max_depth": 2, "n_estimators": 3, "objective": "reg:absoluteerror", "base_score": 5.0, "max_bins": 8}])
def test_boosting_equals_its_definition(rows, params):
    got = by_pos(create_model("XGBRegressor", params).fit(rows).transform(rows))
    want = plain_boosting(A, Y, params["eta"], params["max_depth"], params["n_estimators"], params.get("min_child_weight", 1), params.get("gamma", 0),
                          params.get("reg_lambda", 1.0), params["max_bins"], "objective" in params, base=params.get("base_score"))
    np.testing.assert_allclose(got, want, rtol=1e-9)
    if "gamma" in params:
        assert np.mean((got - Y) ** 2) < 0.5 * Y.var()


def test_boosting_draws_rows_and_features(spark):
    """Draws come from (seed, round, row) and (seed, round), so that a plain definition can repeat them."""
    df = runs.assemble_features(table(spark).coalesce(1).orderBy("pos").coalesce(1), COLS)  # one partition: row ids are positions
    model = Boosted(eta=0.4, max_depth=2, n_estimators=4, subsample=0.6, colsample_bytree=0.7, seed=3, max_bins=16)
    got = by_pos(model.fit(df).transform(df))
    want = plain_boosting(A, Y, 0.4, 2, 4, 1, 0, 1.0, 16, keep=lambda t: uniform(np.arange(N), 3 * 1_000_003 + t) < 0.6,
                          columns=lambda t: sorted(random.Random(f"3|{t}").sample(range(3), 2)))
    np.testing.assert_allclose(got, want, rtol=1e-9)
    draws = uniform(np.arange(100_000), 5)
    assert abs(draws.mean() - 0.5) < 0.01 and abs((draws < 0.1).mean() - 0.1) < 0.01


def test_folds_grow_side_by_side(spark, tmp_path):
    folds = runs.prepared_folds(FO.k_fold(table(spark), N, 3), COLS, scaler=None)
    params = {"eta": 0.3, "max_depth": 2, "n_estimators": 3, "max_bins": 32}
    got = runs.fold_predictions(folds, "XGBRegressor", params).toPandas()
    for fold in range(3):
        own = folds.filter(F.col("fold") == fold)
        alone = create_model("XGBRegressor", params).fit(own.filter("role = 'train'"))
        want = alone.transform(own).toPandas().sort_values(["role", "pos"])
        np.testing.assert_allclose(got[got.fold == fold].sort_values(["role", "pos"]).prediction, want.prediction, rtol=1e-9)
    weights = alone.featureImportances.toArray()
    assert abs(weights.sum() - 1) < 1e-9 and weights[0] == weights.max()
    data = table(spark).withColumn("series_id", F.lit("s")).withColumn("win", F.col("pos"))
    pipeline = runs.fit_pipeline(data, COLS, "XGBRegressor", params)
    pipeline.save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    np.testing.assert_array_equal(by_pos(again.transform(data)), by_pos(pipeline.transform(data)))


def test_extra_trees_equal_their_definition(rows):
    """Given the same drawn cuts, a plain node by node search takes the same splits."""
    model = ExtraTrees(3, 3, 5, 0.7, random_state=6)
    got = by_pos(model.fit(rows).transform(rows))
    total = np.zeros(N)
    for t in range(3):
        def grow(at, node):
            y, best = Y[at], None
            if node < 8 and len(y) >= 10:
                for j in model.tried(t, node, 3):
                    x = A[at, j]
                    if x.min() < x.max():
                        cut = model.draw(t, node, j, x.min(), x.max())
                        left = x < cut
                        if min(left.sum(), (~left).sum()) >= 5:
                            gain = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - y.sum() ** 2 / len(y)
                            if best is None or gain > best[0]:
                                best = gain, j, cut
            if best and best[0] > 0:
                grow(at & (A[:, best[1]] < best[2]), 2 * node)
                grow(at & (A[:, best[1]] >= best[2]), 2 * node + 1)
            else:
                total[at] += y.mean()

        grow(np.ones(N, bool), 1)
    np.testing.assert_allclose(got, total / 3, rtol=1e-9)
    again = by_pos(ExtraTrees(3, 3, 5, 0.7, random_state=6).fit(rows).transform(rows))
    np.testing.assert_allclose(again, got, rtol=1e-12)
    assert not np.allclose(by_pos(ExtraTrees(3, 3, 5, 0.7, random_state=7).fit(rows).transform(rows)), got)


def test_trees_survive_json():
    tree = Trees(1.5, 2, [])
    assert Trees.from_json(tree.to_json()).predict(np.zeros((2, 2))).tolist() == [1.5, 1.5]


# linear models from moments


def plain_line(x, y, model, alpha, scaler):
    mean, scale = x.mean(0), np.ones(x.shape[1])
    if scaler == "StandardScaler":
        scale = x.std(0)
    elif scaler == "MinMaxScaler":
        scale = np.ptp(x, axis=0)
    z, d = (x - mean) / scale, y - y.mean()
    if model == "Lasso":
        w = np.zeros(x.shape[1])
        for _ in range(2000):
            for j in range(len(w)):
                r = z[:, j] @ (d - z @ w + z[:, j] * w[j]) / len(y)
                w[j] = np.sign(r) * max(abs(r) - alpha, 0) / (z[:, j] @ z[:, j] / len(y))
    else:
        w = np.linalg.solve(z.T @ z + alpha * np.eye(len(mean)), z.T @ d)
    return w / scale, y.mean() - (w / scale) @ mean


@pytest.mark.parametrize("scaler", [None, "StandardScaler", "MinMaxScaler"])
def test_linear_models_from_moments(spark, scaler):
    x = A + [0.0, 1e6, -50.0]  # offsets must not cancel
    folds = FO.block_folds(table(spark, x), N, 3, 0.0, 4)
    models = [("LinearRegression", {}), ("Ridge", {"alpha": 7.0}), ("Lasso", {"alpha": 0.3})]
    lines = moments.fit_folds(folds, COLS, models, "ttf", scaler)
    got = moments.predicted(folds, lines, "ttf").toPandas()
    roles = folds.toPandas()
    for fold in range(3):
        train = roles[(roles.fold == fold) & (roles.role == "train")].pos.to_numpy()
        for i, (model, params) in enumerate(models):
            w, b = plain_line(x[train], Y[train], model, params.get("alpha", 0.0), scaler)
            own = got[(got.fold == fold) & (got.model == i)].sort_values("pos")
            np.testing.assert_allclose(own.prediction, x[own.pos] @ w + b, rtol=1e-6, atol=1e-6)
    with pytest.raises(TypeError):
        runs.out_of_fold(folds, COLS, "Ridge", {"beta": 1})
    with pytest.raises(Exception, match="undefined"):
        moments.moments(table(spark).withColumn("a", F.when(F.col("pos") != 5, F.col("a"))), COLS, "ttf", ())


def test_moments_take_few_jobs(spark):
    folds = FO.k_fold(table(spark), N, 4)
    group = "moments-test"
    spark.sparkContext.setJobGroup(group, group)
    moments.fit_folds(folds, COLS, [("Ridge", {"alpha": float(a)}) for a in range(50)], "ttf", "StandardScaler")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) <= 5  # the first row, and one aggregate, whatever the number of models


def test_ridge_search_and_elimination_by_folds(spark):
    noise = np.column_stack([A[:, 0], rng.normal(size=N), A[:, 2]])
    y = 3 * noise[:, 0] + noise[:, 2] + rng.normal(scale=0.05, size=N)
    folds = FO.k_fold(table(spark, noise, y), N, 3)
    found = {r.alpha: r.mean_absolute_error_mean for r in runs.ridge_search(folds, COLS, [0.0, 10.0, 1000.0], ["mean_absolute_error"]).collect()}
    assert found[0.0] < found[10.0] < found[1000.0]
    for model, params in (("LinearRegression", {}), ("XGBRegressor", {"n_estimators": 5, "max_depth": 2, "eta": 0.5, "max_bins": 16})):
        left, tried = selection.recursive_elimination_cv(folds, COLS, "ttf", model, params, step=1)
        assert [size for size, _ in tried] == [3, 2, 1] and set(left) >= {"a"} and tried[2][1] > tried[1][1]
        if model == "LinearRegression":  # the ranking of each fold, plainly
            roles = folds.toPandas()
            for size, value in tried:
                errors = []
                for fold in range(3):
                    own = roles[roles.fold == fold]
                    train, test = (own[own.role == r].pos.to_numpy() for r in ("train", "test"))
                    use = [0, 1, 2]
                    while len(use) > size:
                        w, _ = plain_line(noise[train][:, use], y[train], "Ridge", 0.0, None)
                        use.pop(int(np.argmin(np.abs(w))))
                    w, b = plain_line(noise[train][:, use], y[train], "Ridge", 0.0, None)
                    errors.append(np.abs(y[test] - noise[test][:, use] @ w - b).mean())
                assert value == pytest.approx(np.mean(errors), rel=1e-6)


def test_successive_halving():
    calls = []

    def loss(params, budget):
        calls.append((params["x"], budget))
        return abs(params["x"] - 4) / budget

    out = runs.successive_halving({"x": list(range(9))}, 30, loss, [1, 2, 4], seed=1)
    first = {x for x, b in calls if b == 1}
    assert [b for _, b in calls].count(1) == len(first) and [b for _, b in calls].count(2) == len(first) // 3 and [b for _, b in calls].count(4) == 1
    assert out[0][1] == 4 and out[0][2]["x"] == min(first, key=lambda x: abs(x - 4)) and len(out) == len(first)
    with pytest.raises(ValueError):
        runs.successive_halving({"x": [1]}, 1, loss, [3, 1])


# fold roles


@pytest.mark.parametrize("fragmentation,n", [(0.0, 9000), (0.02, 9000), (0.3, 500)])
def test_roles_by_sweep(spark, fragmentation, n):
    """Fragments that overlap, touch and cross blocks; the lookup has a row per block, not per position."""
    fragments = FO.block_fragments(spark, n, 4, fragmentation, 9, seed=5).toPandas()
    df = spark.range(n).select(F.col("id").alias("pos"))
    got = FO.block_folds(df, n, 4, fragmentation, 9, seed=5).toPandas().pivot(index="pos", columns="fold", values="role")
    for fold in range(4):
        want = np.full(n, "train", object)
        own = fragments[fragments.fold == fold]
        for r in own.itertuples():
            want[r.pad_start:r.pad_end] = np.where(want[r.pad_start:r.pad_end] == "test", "test", "pad")
        for r in own.itertuples():
            want[r.start:r.end] = "test"
        assert (got[fold].to_numpy() == want).all()
    table = FO.block_roles(FO.block_fragments(spark, n, 4, fragmentation, 9, seed=5), 4)
    assert table.count() <= n // FO.ROLE_BLOCK + 1
