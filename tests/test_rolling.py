import numpy as np
import pandas as pd
import pytest

from strideframe.operators.quantiles import exact_quantiles
from strideframe.operators.rolling import r_savgol_filter, r_sta_lta, rolled

rng = np.random.default_rng(0)
X = np.cumsum(rng.normal(size=1500)) * 3 + 100
X[500:700] = 7
Y = np.arange(40.0) ** 3


@pytest.fixture(scope="module")
def s(spark):
    pdf = pd.concat([pd.DataFrame({"series_id": k, "pos": np.arange(len(v)), "x": v}) for k, v in (("a", X), ("b", Y))])
    return spark.createDataFrame(pdf.sample(frac=1, random_state=2)).repartition(3).persist()


def run(s, ops, block=None):
    out = rolled(s, ops, block=block).orderBy("series_id", "pos").toPandas()
    assert len(out) == len(X) + len(Y)
    return out[out.series_id == "a"].x.values, out[out.series_id == "b"].x.values


def savgol(x, w, p):
    h, k = w // 2, np.arange(-(w // 2), w // 2 + 1)
    fit = np.linalg.pinv(np.vander(k, p + 1, increasing=True))
    out = np.array([(fit @ x[c - h:c + h + 1])[0] if h <= c < len(x) - h else 0 for c in range(len(x))])
    first, last = fit @ x[:w], fit @ x[-w:]
    out[:h] = [np.polyval(first[::-1], i - h) for i in range(h)]
    out[-h:] = [np.polyval(last[::-1], i) for i in range(1, h + 1)]
    return out


def sta_lta(x, a, b):
    c = np.cumsum(x ** 2)
    sta, lta = c.copy(), c.copy()
    sta[a:] -= c[:-a]
    lta[b:] -= c[:-b]
    sta /= a
    sta[:b - 1] = 0
    return sta / np.maximum(lta / b, 2.2250738585072014e-308)


@pytest.mark.parametrize("block", [None, 97, 256])
@pytest.mark.parametrize("w", [1, 2, 30])
def test_moving_mean_and_deviation(s, block, w):
    for x, m, d in zip((X, Y), run(s, [("r_mean", {"window_size": w})], block), run(s, [("r_std", {"window_size": w})], block)):
        roll = pd.Series(x).rolling(w, min_periods=1)
        np.testing.assert_allclose(m, roll.mean(), rtol=1e-10, atol=1e-9)
        np.testing.assert_allclose(d, roll.std(ddof=0), rtol=1e-9, atol=1e-6)
    assert (run(s, [("r_std", {"window_size": w})], block)[0][600:690] == 0).all()


def test_sta_lta(s):
    got = run(s, [("r_sta_lta", {"sta_window": 5, "lta_window": 20})], 64)
    for x, g in zip((X, Y), got):
        np.testing.assert_allclose(g, sta_lta(x, 5, 20), rtol=1e-8)
    with pytest.raises(ValueError):
        r_sta_lta(10, 5)


@pytest.mark.parametrize("w,p", [(11, 0), (11, 1), (31, 1), (11, 2), (31, 2), (11, 3), (1, 0)])
def test_savgol(s, w, p):
    for x, g in zip((X, Y), run(s, [("r_savgol_filter", {"window_length": w, "polyorder": p})], 200)):
        np.testing.assert_allclose(g, savgol(x, w, p) if w > 1 else x, rtol=1e-8, atol=1e-6)


def test_savgol_arguments(s):
    with pytest.raises(ValueError):
        r_savgol_filter(10, 1)
    with pytest.raises(Exception, match="greater than the series"):
        rolled(s, [("r_savgol_filter", {"window_length": 41})]).collect()


def test_chain_with_clip(s):
    got, _ = run(s, [("r_std", {"window_size": 50}), ("r_savgol_filter", {"window_length": 31}), ("r_clip", {"q_low": .1, "q_high": .9}),
                     ("r_mean", {"window_size": 3})], 400)
    y = savgol(pd.Series(X).rolling(50, min_periods=1).std(ddof=0).values, 31, 1)
    want = pd.Series(np.clip(y, *np.quantile(y, [.1, .9]))).rolling(3, min_periods=1).mean()
    np.testing.assert_allclose(got, want, rtol=1e-8, atol=1e-6)


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_exact_quantiles(s, accuracy):
    qs = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.977, "e": 1.0}
    got = exact_quantiles(s, ["series_id"], "x", qs, accuracy).orderBy("series_id").toPandas()
    for i, x in enumerate((X, Y)):
        np.testing.assert_allclose(got.iloc[i, 1:].astype(float), np.quantile(x, list(qs.values())), rtol=1e-12)


def test_golden(spark):
    x = [1, 3, 2, 2, 5, 0, 4, 4, 1, 6]
    s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "series_id string, pos bigint, x double")
    get = lambda *ops: [r.x for r in rolled(s, list(ops)).orderBy("pos").collect()]
    np.testing.assert_allclose(get(("r_std", {"window_size": 3})),
                               [0, 1, .816497, .471405, 1.414214, 2.054805, 2.160247, 1.885618, 1.414214, 2.054805], atol=1e-6)
    np.testing.assert_allclose(get(("r_sta_lta", {"sta_window": 2, "lta_window": 4})),
                               [0, 0, 0, .888889, 1.380952, 1.515152, .711111, 1.122807, 1.030303, 1.072464], atol=1e-6)
    np.testing.assert_allclose(get(("r_clip", {"q_low": .1, "q_high": .9})), [1, 3, 2, 2, 5, .9, 4, 4, 1, 5.1])


def test_plan_has_one_exchange(s):
    df = rolled(s, [("r_std", {"window_size": 50}), ("r_mean", {"window_size": 5})])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
