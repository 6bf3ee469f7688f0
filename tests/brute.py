"""Plain per-window definitions, one window at a time; the tests compare the Spark operators with them."""

import numpy as np
import pandas as pd

NAN = float("nan")


def starts(n, size, stride):
    return [i for i in range(0, n - size + stride, stride) if i < n]


def diff_share(x):
    hits = [i for i in range(len(x) - 1) if x[i + 1] != x[i] or x[i] == 0]
    return np.mean(hits) if hits else NAN


def run(flags):
    best = cur = 0
    for f in flags:
        cur = cur + 1 if f else 0
        best = max(best, cur)
    return best


def autocorrelation(x, lag):
    if len(x) <= lag or x.var() <= 1e-8:
        return NAN
    d = x - x.mean()
    return (d[:len(x) - lag] * d[lag:]).sum() / ((len(x) - lag) * x.var())


def integral(x, q=0.7):
    k = x[x < np.quantile(x, q)]
    return np.trapezoid(k) if len(k) > 1 else 0.0


def entropy(x, bins=100):
    edges = np.linspace(x.min(), x.max(), bins + 1)
    b = np.minimum(np.searchsorted(edges, x, "right") - 1, bins - 1) if np.ptp(x) else np.zeros(len(x))
    p = np.unique(b, return_counts=True)[1] / len(x)
    return -(p * np.log(p)).sum()


def approximate_entropy(x, m=3, r=3):
    if len(x) <= m + 1:
        return 0.0

    def phi(m):
        e = np.array([x[i:i + m] for i in range(len(x) - m + 1)])
        c = (np.abs(e[:, None] - e[None]).max(2) <= r * x.std()).mean(0)
        return np.log(c).mean()
    return abs(phi(m) - phi(m + 1))


def slotted(x):
    d = x - x.mean()
    for k in range(1, len(x)):
        if (d[:-k] * d[k:]).mean() < np.exp(-1) * (d * d).mean():
            return k
    return NAN


def at(x, share):
    return np.sort(x)[min(int(np.ceil(share * len(x))), len(x) - 1)]


def gskew(x):
    lo, hi = np.quantile(x, .03), np.quantile(x, .97)
    return np.median(x[x <= lo]) + np.median(x[x >= hi]) - 2 * np.median(x)


def con(x):
    f = np.abs(x - x.mean()) > 2 * x.std()
    return sum(f[i] and f[i + 1] and f[i + 2] for i in range(len(x) - 2)) / (len(x) - 2)


def slope30(x):
    d = np.diff(x[-30:])
    return ((d > 0).sum() - (d <= 0).sum()) / 30


def psd(x, fs=4e6):
    p = np.abs(np.fft.rfft(x - x.mean())) ** 2 / (fs * len(x))
    p[1:len(p) - (len(x) % 2 == 0)] *= 2
    return p


def c3(x, lag):
    m = len(x) - 2 * lag
    return 0.0 if m <= 0 else (x[2 * lag:] * x[lag:lag + m] * x[:m]).mean()


def reversal(x, lag):
    m = len(x) - 2 * lag
    return 0.0 if m <= 0 else (x[2 * lag:] ** 2 * x[lag:lag + m] - x[lag:lag + m] * x[:m] ** 2).mean()


def moment(x, p):
    s = pd.Series(x)
    return s.skew() if p == 3 else s.kurt()


def rcs(x):
    w = np.cumsum(x - x.mean())
    return (w.max() - w.min()) / (len(x) * x.std())


# name -> (operator, params, definition)
CASES = {
    "psd_sum": ("w_psd_sum", {}, lambda x: psd(x).sum()),
    "last": ("w_last_elem", {}, lambda x: x[-1]),
    "minimum": ("w_min", {}, np.min), "maximum": ("w_max", {}, np.max),
    "avg": ("w_mean", {}, np.mean), "std": ("w_std", {}, lambda x: 0.0 if np.ptp(x) == 0 else x.std()),
    "energy": ("w_abs_energy", {}, lambda x: (x * x).sum()),
    "av_change_abs": ("w_av_change_abs", {}, lambda x: np.diff(x).mean()),
    "mean_change": ("w_mean_change", {}, lambda x: np.diff(x).mean()),
    "av_change_rate": ("w_av_change_rate", {}, diff_share),
    "first_max": ("w_first_location_of_maximum", {}, lambda x: x.argmax() / len(x)),
    "last_max": ("w_last_location_of_maximum", {}, lambda x: 1 - x[::-1].argmax() / len(x)),
    "first_min": ("w_first_location_of_minimum", {}, lambda x: x.argmin() / len(x)),
    "last_min": ("w_last_location_of_minimum", {}, lambda x: 1 - x[::-1].argmin() / len(x)),
    "skew": ("w_skewness", {}, lambda x: moment(x, 3)), "kurt": ("w_kurtosis", {}, lambda x: moment(x, 4)),
    "large_std": ("w_large_standard_deviation", {"r": 0.25}, lambda x: x.std() > 0.25 * np.ptp(x)),
    "trend": ("w_linear_trend", {}, lambda x: np.polyfit(np.arange(len(x)), x, 1)[0]),
    "abs_changes": ("w_absolute_sum_of_changes", {}, lambda x: np.abs(np.diff(x)).sum()),
    "mean_abs_change": ("w_mean_abs_change", {}, lambda x: np.abs(np.diff(x)).mean()),
    "eta_e": ("w_eta_e", {}, lambda x: (np.diff(x) ** 2).mean() / x.var() if np.ptp(x) else NAN),
    "second": ("w_mean_second_derivative_central", {}, lambda x: ((x[2:] - 2 * x[1:-1] + x[:-2]) / 2).mean()),
    "ac2": ("w_autocorrelation", {"lag": 2}, lambda x: autocorrelation(x, 2)),
    "ac10": ("w_autocorrelation", {}, lambda x: autocorrelation(x, 10)),
    "c3_5": ("w_c3", {"lag": 5}, lambda x: c3(x, 5)), "c3_100": ("w_c3", {}, lambda x: c3(x, 100)),
    "reversal": ("w_time_reversal_asymmetry_statistic", {"lag": 7}, lambda x: reversal(x, 7)),
    "crossing": ("w_number_crossing_m", {"m": 0.1}, lambda x: (np.diff(x > 0.1) != 0).sum()),
    "crossing_m1": ("w_number_crossing_m", {"m": -1.5}, lambda x: (np.diff(x > -1.5) != 0).sum()),
    "pair_slope": ("w_pair_slope_trend", {}, slope30),
    "q05": ("w_quantile", {}, lambda x: np.quantile(x, .05)), "q90": ("w_quantile", {"q": 0.9}, lambda x: np.quantile(x, .9)),
    "median": ("w_median", {}, np.median),
    "irq": ("w_irq", {}, lambda x: np.quantile(x, .75) - np.quantile(x, .25)),
    "q31": ("w_q31", {}, lambda x: np.quantile(x, .75) - np.quantile(x, .25)),
    "integral": ("w_integral", {}, integral), "integral1": ("w_integral", {"q": 0.1}, lambda x: integral(x, .1)),
    "entropy": ("w_binned_entropy", {}, entropy),
    "above": ("w_count_above_mean", {}, lambda x: (x > x.mean()).sum()),
    "below": ("w_count_below_mean", {}, lambda x: (x < x.mean()).sum()),
    "run_above": ("w_longest_strike_above_mean", {}, lambda x: run(x > x.mean())),
    "run_below": ("w_longest_strike_below_mean", {}, lambda x: run(x < x.mean())),
    "beyond": ("w_ratio_beyond_r_sigma", {"r": 1.5}, lambda x: (np.abs(x - x.mean()) > 1.5 * x.std()).mean()),
    "con": ("w_con", {}, con),
    "pdfp": ("w_percent_difference_flux_percentile", {}, lambda x: (at(x, .95) - at(x, .05)) / np.median(x)),
    "flux": ("w_flux_percentile_ratio_sum", {}, lambda x: sum(at(x, b) - at(x, a) for a, b in (
        (.4, .6), (.25, .75), (.1, .9))) / (at(x, .95) - at(x, .05))),
    "gskew": ("w_gskew", {}, gskew),
    "brp": ("w_median_BRP", {}, lambda x: ((x < np.median(x) + np.ptp(x) / 10) & (x > np.median(x) - np.ptp(x) / 10)).mean()),
    "rcs": ("w_rcs", {}, rcs),
    "apen": ("w_approximate_entropy", {"m": 2, "r": 0.4}, lambda x: approximate_entropy(x, 2, .4)),
    "slotted": ("w_slottedA_length", {}, slotted),
    "fft_r": ("w_fft_rmean_last_5000", {"k": 17}, lambda x: np.fft.fft(x)[-17:].real.mean()),
    "fft_l": ("w_fft_lmean_last_5000", {"k": 17}, lambda x: np.fft.fft(x)[-17:].imag.mean()),
    "fft_r_all": ("w_fft_rmean_last_5000", {}, lambda x: np.fft.fft(x)[-5000:].real.mean()),
}


def table(x, size, stride, names=None):
    """DataFrame of all cases over the windows of one series."""
    rows = []
    for win, i in enumerate(starts(len(x), size, stride)):
        w = np.asarray(x[i:i + size], float)
        with np.errstate(all="ignore"):
            rows.append({"win": win, **{k: float(f(w)) for k, (_, _, f) in CASES.items() if names is None or k in names}})
    return pd.DataFrame(rows)
