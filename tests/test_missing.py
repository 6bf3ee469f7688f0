"""Missing values are left out, in every operator and on every path; gaps in the positions are an error."""

import numpy as np
import pytest

from strideframe.operators import kernels
from strideframe.operators.rolling import rolled
from strideframe.operators.windows import window_features

from .brute import CASES

NAN = float("nan")
rng = np.random.default_rng(8)
X = rng.normal(size=400).round(1)
X[rng.choice(400, 60, replace=False)] = NAN
X[100:170] = 1.5  # constant, then nothing at all
X[170:240] = NAN


def table(spark, x):
    return spark.createDataFrame([("a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "series_id string, pos bigint, x double")


PAIRS = {"w_autocorrelation", "w_c3", "w_time_reversal_asymmetry_statistic", "w_number_crossing_m", "w_pair_slope_trend", "w_av_change_rate", "w_linear_trend",
         "w_first_location_of_maximum", "w_last_location_of_maximum", "w_first_location_of_minimum", "w_last_location_of_minimum", "w_absolute_sum_of_changes", "w_mean_abs_change",
         "w_eta_e", "w_mean_second_derivative_central", "w_av_change_abs", "w_mean_change", "w_slottedA_length", "w_approximate_entropy", "w_number_cwt_peaks"}
VALUES = {k: v for k, v in CASES.items() if v[0] not in PAIRS | kernels.EVEN and v[0] in kernels.KERNELS or v[0] in (
    "w_mean", "w_std", "w_min", "w_max", "w_skewness", "w_kurtosis", "w_abs_energy", "w_last_elem", "w_psd_sum", "w_large_standard_deviation")}


@pytest.mark.parametrize("size,stride", [(30, 10), (70, 70)])
def test_windows_leave_missing_values_out(spark, size, stride):
    got = window_features(table(spark, X), {k: (op, p) for k, (op, p, _) in VALUES.items()}, size, stride).orderBy("win").toPandas()
    empty = 0
    for win, row in got.iterrows():
        x = X[win * stride:win * stride + size]
        x = x[~np.isnan(x)]
        empty += not len(x)
        for name, (op, _, plain) in VALUES.items():
            if not len(x):
                assert row[name] is None or row[name] != row[name], name
            elif len(x) > 4:
                with np.errstate(all="ignore"):
                    want = plain(x)
                if np.ndim(want) == 0 and np.isfinite(want):
                    np.testing.assert_allclose(float(row[name]), float(want), rtol=1e-7, atol=1e-9, err_msg=f"{name} {win}")
    assert empty or size == 70


def test_pairs_need_both_values(spark):
    got = window_features(table(spark, X), {"change": ("w_mean_abs_change", {}), "steps": ("w_absolute_sum_of_changes", {}), "bend": ("w_mean_second_derivative_central", {}),
                                            "trend": ("w_linear_trend", {}), "cubic": ("w_c3", {"lag": 2})}, 50, 25).orderBy("win").toPandas()
    for win, row in got.iterrows():
        x = X[win * 25:win * 25 + 50]
        there = ~np.isnan(x)
        if not there.any():
            assert row.isna().sum() == 5
            continue
        d = np.abs(np.diff(x))
        np.testing.assert_allclose([row.change, row.steps, row.bend, row.cubic, row.trend], [
            np.nanmean(d), np.nansum(d), np.nanmean((x[2:] - 2 * x[1:-1] + x[:-2]) / 2), np.nanmean(x[4:] * x[2:-2] * x[:-4]),
            np.polyfit(np.flatnonzero(there), x[there], 1)[0]], rtol=1e-7, atol=1e-9)


def test_long_windows_answer_as_short_ones(spark, monkeypatch):
    features = {k: (op, p) for k, (op, p, _) in VALUES.items() if op in kernels.BY_RANK}
    for x in (X, np.full(400, 2.0), np.round(rng.normal(size=400))):
        monkeypatch.setattr(kernels, "LONG_WINDOW", 4096)
        a = window_features(table(spark, x), features, 60, 10).orderBy("win").toPandas()
        expected = [kernels._with_missing(w, np.isnan(w.v).any(1), "w_quantile", {"q": 0.05}) for _, w in kernels._windows(x, 60, 10, 10**6)]
        monkeypatch.setattr(kernels, "LONG_WINDOW", 8)
        sliding = [kernels._with_missing(w, np.isnan(w.v).any(1), "w_quantile", {"q": 0.05}) for _, w in kernels._windows(x, 60, 10, 10**6)]
        flat = lambda parts: [NAN if y is None else y for p in parts for y in p]
        np.testing.assert_allclose(flat(sliding), flat(expected))
        if "quantile" in a:
            np.testing.assert_allclose(a["quantile"].astype(float), flat(expected))


def test_gaps_and_doubled_positions_are_errors(spark):
    s = table(spark, np.arange(100.0))
    for broken in (s.filter("pos <> 50"), s.union(s.filter("pos = 50"))):
        with pytest.raises(Exception, match="gaps or doubled"):
            window_features(broken, {"m": ("w_median", {})}, 30, 10).collect()


def test_moving_operators(spark):
    import pandas as pd

    s = pd.Series(X)
    for w in (1, 2, 7, 40):
        for op, want in (("r_mean", s.rolling(w, min_periods=1).mean()), ("r_std", s.rolling(w, min_periods=1).std(ddof=0))):
            got = rolled(table(spark, X), [(op, {"window_size": w})], block=90).orderBy("pos").toPandas()
            np.testing.assert_allclose(got.x.astype(float), want, atol=1e-7, err_msg=f"{op} {w}")


def test_deviation_over_a_level_step(spark):
    x = np.concatenate([rng.normal(size=500), 1e8 + rng.normal(size=500)]) * 0.01
    got = rolled(table(spark, x), [("r_std", {"window_size": 50})]).orderBy("pos").toPandas().x.to_numpy()
    want = np.array([x[max(0, i - 49):i + 1].std() for i in range(1000)])
    np.testing.assert_allclose(got, want, rtol=1e-6, atol=1e-9)


def test_smoothing_is_null_where_a_value_is_missing(spark):
    got = rolled(table(spark, X), [("r_savgol_filter", {"window_length": 5, "polyorder": 1})], block=60).orderBy("pos").toPandas().x.astype(float)
    for i in range(2, 398):
        w = X[i - 2:i + 3]
        assert np.isnan(got[i]) == np.isnan(w).any()
        if not np.isnan(w).any():
            assert abs(got[i] - w.mean()) < 1e-9


def test_clip_keeps_missing_values_missing(spark):
    got = rolled(table(spark, X), [("r_clip", {"q_low": 0.1, "q_high": 0.9})]).orderBy("pos").toPandas().x.astype(float)
    np.testing.assert_allclose(got, np.clip(X, *np.nanquantile(X, [0.1, 0.9])))


@pytest.mark.parametrize("kind", ["holes", "steps", "ties", "nothing"])
def test_rank_structure_with_holes_and_sums(kind):
    """Every feature by ranks: moving windows with missing values against the values of each window."""
    draw = np.random.default_rng(3)
    x = np.cumsum(draw.normal(size=7000)) if kind == "steps" else draw.normal(size=7000).round(1 if kind == "ties" else 9)
    x[draw.random(7000) < 0.2] = NAN
    x[2000:3100] = NAN
    if kind == "nothing":
        x[:] = NAN
    w = kernels.SlidingWindows(x, 1000, 40, (7000 - 1000) // 40 + 1)
    plain = kernels.Windows(w.v)
    missing = np.isnan(w.v).any(1)
    for op in sorted(kernels.BY_RANK):
        with np.errstate(all="ignore"):
            got, want = kernels._feature(w, missing, op, {}), kernels._with_missing(plain, missing, op, {})
        assert [y is None for y in got] == [y is None for y in want], op
        np.testing.assert_allclose([y for y in got if y is not None], [y for y in want if y is not None], rtol=1e-9, atol=1e-9, err_msg=op)


def test_work_per_window_follows_the_stride():
    """Half the stride, half the values looked at per window; the length of the window does not matter."""
    x = np.random.default_rng(4).normal(size=200_000)
    x[::17] = NAN
    touched = {}
    for size, stride in ((20_000, 2_000), (20_000, 4_000), (80_000, 2_000)):
        w = kernels.SlidingWindows(x, size, stride, 25)
        for op in ("w_quantile", "w_integral", "w_gskew"):
            w.touched = 0
            kernels.KERNELS[op][1](w)
            touched[op, size, stride] = (w.touched - 2 * size) / 25
    for op in ("w_quantile", "w_integral", "w_gskew"):
        assert touched[op, 20_000, 2_000] < 0.8 * touched[op, 20_000, 4_000]
        assert touched[op, 80_000, 2_000] < 1.6 * touched[op, 20_000, 2_000]
        assert touched[op, 80_000, 2_000] < 80_000
