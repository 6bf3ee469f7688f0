import numpy as np
import pandas as pd
import pytest

from strideframe.operators.kernels import KERNELS
from strideframe.operators.panes import PANE_OPS
from strideframe.operators.windows import window_features
from tests import brute

FEATURES = {k: (op, params) for k, (op, params, _) in brute.CASES.items()}


def make(spark, **series):
    frames = [pd.DataFrame({"series_id": k, "pos": np.arange(len(v)), "x": np.asarray(v, float)}) for k, v in series.items()]
    return spark.createDataFrame(pd.concat(frames).sample(frac=1, random_state=1), "series_id string, pos bigint, x double").repartition(3)


def check(got, want, names):
    assert list(got.win) == list(want.win)
    for k in names:
        np.testing.assert_allclose(got[k].astype(float), want[k].astype(float), rtol=1e-7, atol=1e-9, err_msg=k, equal_nan=True)


rng = np.random.default_rng(7)
NOISE = np.round(np.cumsum(rng.normal(size=613)) + rng.normal(size=613) * 3, 1) + 0.05
TIES = rng.integers(-2, 3, size=400).astype(float)


@pytest.mark.parametrize("x", [NOISE, TIES, NOISE + 1e4], ids=["noise", "ties", "offset"])
@pytest.mark.parametrize("size,stride,block", [(64, 16, None), (50, 17, 1), (40, 60, 1), (48, 48, 1)])
def test_features_match_definitions(spark, x, size, stride, block):
    got = window_features(make(spark, a=x, b=x[:size]), FEATURES, size, stride, block=block).orderBy("series_id", "win").toPandas()
    want = brute.table(x, size, stride)
    names = [k for k in FEATURES]
    check(got[got.series_id == "a"].reset_index(), want, names)
    check(got[got.series_id == "b"].reset_index(), brute.table(x[:size], size, stride), names)


def test_constant_window(spark):
    x = np.full(50, 3.3)
    names = ["std", "skew", "kurt", "ac2", "eta_e", "entropy", "above", "psd_sum", "first_max", "last_max", "crossing", "av_change_rate", "trend"]
    got = window_features(make(spark, a=x), {k: FEATURES[k] for k in names}, 50, 10).toPandas()
    assert (got["std"][0], got["skew"][0], got["kurt"][0], got["entropy"][0], got["psd_sum"][0]) == (0, 0, 0, 0, 0)
    assert np.isnan(got["ac2"][0]) and np.isnan(got["eta_e"][0]) and np.isnan(got["av_change_rate"][0])
    assert got["first_max"][0] == 0 and got["last_max"][0] == 1


def test_golden(spark):
    s = make(spark, a=[1, 3, 2, 2, 5, 0, 4, 4, 1, 6])
    names = ["avg", "std", "q05", "last", "integral", "mean_abs_change", "av_change_abs", "av_change_rate", "above", "psd_sum"]
    got = window_features(s, {k: FEATURES[k] for k in names}, 4, 4).orderBy("win").toPandas()
    want = [[2.0, .707107, 1.15, 2, 3.5, 1, .333333, .5, 1, 5e-07],
            [3.25, 1.920286, .6, 4, 6, 3, -.333333, .5, 3, 3.6875e-06], [3.5, 2.5, 1.25, 6, 0, 5, 5, 0, 1, 3.125e-06]]
    np.testing.assert_allclose(got[names].astype(float).values, want, rtol=1e-5)


def test_short_series(spark):
    s = make(spark, a=range(20), b=range(7))
    for f in ("avg", "q05"):
        with pytest.raises(Exception, match="fewer"):
            window_features(s, {"f": FEATURES[f]}, 10, 5).collect()
        kept = window_features(s, {"f": FEATURES[f]}, 10, 5, short="drop").toPandas()
        assert set(kept.series_id) == {"a"} and len(kept) == 3


def test_bad_arguments(spark):
    s = make(spark, a=range(20))
    with pytest.raises(TypeError):
        window_features(s, {"f": FEATURES["avg"]}, 10.0, 5)
    with pytest.raises(KeyError):
        window_features(s, {"f": ("w_nothing", {})}, 10, 5)


def test_row_prefix_and_label(spark):
    s = make(spark, a=NOISE).selectExpr("*", "pos * 2.0 as ttf")
    y = pd.Series(NOISE).rolling(20, min_periods=1).std(ddof=0).values
    names = ["avg", "std", "q05", "mean_abs_change", "last", "integral"]
    got = window_features(s, {k: FEATURES[k] for k in names}, 64, 24, rows=[("r_std", {"window_size": 20})], label=True, block=1).orderBy("win").toPandas()
    check(got, brute.table(y, 64, 24, names), names)
    want = [2 * (min(i + 64, len(NOISE)) - 1) for i in brute.starts(len(NOISE), 64, 24)]
    assert list(got.ttf) == want


def test_arrays(spark):
    ops = {"psd": ("w_psd", {}), "head": ("w_periodogram", {"N": 5}), "spec": ("w_spectrogram_downsampled", {"nperseg": 20, "noverlap": 4}),
           "peak": ("w_max_smoothed_periodogram", {"window_length": 5, "bins": 10})}
    got = window_features(make(spark, a=NOISE), ops, 101, 60, block=1).orderBy("win").toPandas()
    for win, i in enumerate(brute.starts(len(NOISE), 101, 60)):
        p = brute.psd(NOISE[i:i + 101])
        np.testing.assert_allclose(got.psd[win], p, rtol=1e-8, atol=1e-18)
        np.testing.assert_allclose(got["head"][win], p[:5], rtol=1e-8, atol=1e-18)
        x = NOISE[i:i + 101]
        taper = np.array([(1 - np.cos(np.pi * min(k, 20 - k) / 2.5)) / 2 if min(k, 20 - k) < 2.5 else 1 for k in range(20)])
        frames = []
        for j in range(0, len(x) - 19, 16):
            seg = (x[j:j + 20] - x[j:j + 20].mean()) * taper
            b = np.abs(np.fft.rfft(seg)) ** 2 / (4e6 * (taper ** 2).sum())
            b[1:-1] *= 2
            for _ in range(3):
                b = np.convolve(b, [.25] * 4)[::4]
            frames += list(b)
        np.testing.assert_allclose(got.spec[win], frames, rtol=1e-8, atol=1e-18)


def test_cwt_peaks_counts_isolated_bumps(spark):
    x = np.zeros(200)
    x[[30, 90, 150]] = 10
    x += rng.normal(size=200) * 1e-3
    got = window_features(make(spark, a=x), {"p": ("w_number_cwt_peaks", {"n": 5})}, 200, 200).toPandas()
    assert got.p[0] >= 3


def test_incremental_ranks_equal_sorting(spark):
    x = np.round(np.cumsum(rng.normal(size=9000)), 1)
    names = ["q05", "q90", "median", "irq", "integral", "above", "below", "pdfp", "flux", "gskew", "brp", "beyond", "entropy", "run_above", "rcs", "con"]
    got = window_features(make(spark, a=x), {k: FEATURES[k] for k in names}, 5000, 333).orderBy("win").toPandas()
    check(got, brute.table(x, 5000, 333, names), names)


def test_every_operator_has_a_case():
    covered = {op for op, _, _ in brute.CASES.values()} | {"w_psd", "w_periodogram", "w_spectrogram_downsampled",
                                                           "w_max_smoothed_periodogram", "w_number_cwt_peaks"}
    assert covered == {*PANE_OPS, *KERNELS}


@pytest.mark.parametrize("r", [0.2, 1.0, 3.0])
def test_close_runs_by_bits(r):
    """Sets of bits count the same close runs as plain comparisons, ties at the tolerance included."""
    from strideframe.operators import kernels

    for x in (rng.normal(size=700), rng.integers(0, 9, 517).astype(float), np.full(130, 2.5), np.cumsum(rng.normal(size=300))):
        for m in (1, 2, 3):
            short, long = kernels.CloseSets(x, r * x.std()).close_runs(m)
            np.testing.assert_array_equal(short, kernels._close_by_strips(x, m, r * x.std()))
            np.testing.assert_array_equal(long, kernels._close_by_strips(x, m + 1, r * x.std()))


def test_approximate_entropy_of_a_long_window():
    import time

    from strideframe.operators import kernels

    x = np.random.default_rng(0).normal(size=150_000)
    start = time.perf_counter()
    y = kernels._approximate_entropy(kernels.Windows(x[None, :]), 3, 0.2)[0]
    assert time.perf_counter() - start < 60 and 1.5 < y < 2.5
