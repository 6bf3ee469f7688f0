"""Window features that need the ordered or sorted values of each window.

Spark cuts the series into halo blocks; each grouped Arrow call gets one block (a few
window lengths of rows) and evaluates all its windows as the rows of a strided 2-D view.  Rows are
thus shuffled 1.25 times, whatever the overlap W/S of the windows, and each feature is one short
array expression.

Missing values (NULL) are left out: a window with some is evaluated over the values it has, in their
order; without any it has NULL.  Spectra need evenly spaced values and are NULL then.
"""

from __future__ import annotations

from functools import cached_property
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Frame, per_block
from ..series import KEY
from . import spectral

CHUNK = 1 << 22  # values materialised at a time
LONG_WINDOW = 4096  # from here on, overlapping windows are ranked incrementally
BUCKET = 10  # ranks are counted in buckets of 2**BUCKET
REFRESH = 64  # sums by bucket are taken anew after so many windows


class Windows:
    """k windows of ``size`` rows each, as a (strided) 2-D view; what several features share is computed once.

    ``n`` is the number of values that a window has: the same for all here, as no value is missing.
    """

    def __init__(self, v: np.ndarray):
        self.v, self.size = v, v.shape[1]
        self.n = self.size

    def by_chunk(self, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Apply an array expression to a few windows at a time, so that its temporaries stay small."""
        step = max(1, CHUNK // self.size)
        return np.concatenate([fn(self.v[i:i + step]) for i in range(0, len(self.v), step)])

    @cached_property
    def mean(self) -> np.ndarray:
        return self.by_chunk(lambda v: v.mean(axis=1))[:, None]

    @cached_property
    def std(self) -> np.ndarray:
        return self.by_chunk(lambda v: v.std(axis=1))[:, None]

    def chunks(self) -> Iterator["Windows"]:
        step = max(1, CHUNK // self.size)
        for i in range(0, len(self.v), step):
            part = type(self)(self.v[i:i + step])
            for name in ("mean", "std"):
                if name in self.__dict__:
                    part.__dict__[name] = self.__dict__[name][i:i + step]
            yield part

    @cached_property
    def _sorted(self) -> np.ndarray:
        return np.sort(self.v, axis=1)

    def kth(self, ks: list) -> np.ndarray:
        """The ks-th smallest values (from 0) of each window, one column each; a rank is one number or one per window."""
        return np.take_along_axis(self._sorted, self._per_window(ks), 1)

    def _per_window(self, ks: list) -> np.ndarray:
        return np.stack([np.broadcast_to(k, len(self.v)) for k in ks], 1).astype(np.int64)

    def below(self, limit: np.ndarray, side: str = "left") -> np.ndarray:
        """How many values of each window are < its limit (<= with side="right")."""
        limit = limit.reshape(-1, 1)
        return ((self.v < limit) if side == "left" else (self.v <= limit)).sum(1)

    def trapezoid_below(self, limit: np.ndarray) -> np.ndarray:
        """Trapezoid rule over the values below each window's limit, at unit spacing; 0 for fewer than two values."""
        kept = (x[x < top] for x, top in zip(self.v, limit))
        return np.array([k.sum() - (k[0] + k[-1]) / 2 if len(k) > 1 else 0.0 for k in kept])

    def histogram(self, bins: int) -> np.ndarray:
        """Counts in bins of equal width from the smallest to the largest value of each window."""
        return np.array([np.histogram(x, bins)[0] for x in self.v])

    def quantile(self, q: float) -> np.ndarray:
        at = q * (self.n - 1)
        a, b = self.kth([np.floor(at), np.ceil(at)]).T
        return a + (b - a) * (at - np.floor(at))

    def order_statistic(self, share: float) -> np.ndarray:
        return self.kth([np.minimum(np.ceil(share * self.n), self.n - 1)])[:, 0]

    def median_of_ranks(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Median of ``count`` values from rank ``first`` on."""
        a, b = self.kth([first + (count - 1) // 2, first + count // 2]).T
        return (a + b) / 2


class SlidingWindows(Windows):
    """Long windows with large overlap: from one to the next, only ``stride`` values leave and enter.

    The values that are there are sorted once per block; a missing one has no rank, so it is never counted.  Moving on updates, for
    the ranks that leave and enter, a presence flag each and per bucket of ranks a count, a sum, and the first and last position.
    An order statistic, a count below a limit, or the sum and the ends of the values below a limit are then found from the buckets and
    inside one bucket, instead of from all values of the window.  ``touched`` counts the values looked at.
    """

    def __init__(self, buf: np.ndarray, size: int, stride: int, count: int):
        super().__init__(np.lib.stride_tricks.sliding_window_view(buf, size)[::stride][:count])
        there = np.flatnonzero(~np.isnan(buf))
        self.at = there[np.argsort(buf[there], kind="stable")]  # the position of each rank
        self.values, self.stride, self.length, self.touched = buf[self.at], stride, len(buf), 0
        self.ranks = np.full(len(buf), -1)
        self.ranks[self.at] = np.arange(len(self.at))
        self.starts = np.arange(count) * stride
        upto = np.append(0, np.cumsum(~np.isnan(buf)))
        self.n = upto[self.starts + size] - upto[self.starts]
        self.buckets = (len(self.values) >> BUCKET) + 1

    def chunks(self) -> Iterator[Windows]:
        return Windows(self.v).chunks()

    @cached_property
    def mean(self) -> np.ndarray:
        """Differences of running sums, of values less a whole number near their mean."""
        shift = np.round(self.values.mean()) if len(self.values) else 0.0
        x = np.zeros(self.length)
        x[self.at] = self.values - shift
        upto = np.append(0.0, np.cumsum(x))
        return (shift + (upto[self.starts + self.size] - upto[self.starts]) / self.n)[:, None]

    def _slide(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per window: presence by rank, values up to each bucket, and the ranks that have left and entered."""
        present = np.zeros(self.buckets << BUCKET, bool)
        counts = np.zeros(self.buckets, np.int64)
        done = 0
        for start in self.starts:
            gone, new = self.ranks[max(start - self.stride, 0):start], self.ranks[done:start + self.size]
            gone, new, done = gone[gone >= 0], new[new >= 0], start + self.size
            present[gone], present[new] = False, True
            counts += np.bincount(new >> BUCKET, minlength=self.buckets) - np.bincount(gone >> BUCKET, minlength=self.buckets)
            self.touched += len(gone) + len(new)
            yield present, np.cumsum(counts), gone, new

    def _bucket(self, present: np.ndarray, b: int) -> np.ndarray:
        self.touched += 1 << BUCKET
        return present[b << BUCKET:(b + 1) << BUCKET]

    def kth(self, ks: list) -> np.ndarray:
        out = np.full((len(self.v), len(ks)), np.nan)
        for row, ranks, n, (present, upto, _, _) in zip(out, self._per_window(ks), self.n, self._slide()):
            if n:
                for j, (k, b) in enumerate(zip(ranks, np.searchsorted(upto, ranks, side="right"))):
                    inside = np.flatnonzero(self._bucket(present, b))
                    row[j] = self.values[(b << BUCKET) + inside[k - (upto[b - 1] if b else 0)]]
        return out

    def counts_below(self, limits: np.ndarray, side: str = "left") -> np.ndarray:
        """How many values of each window are below each of its limits."""
        ranks = np.searchsorted(self.values, limits.ravel(), side=side).reshape(limits.shape)
        out, within = np.empty(ranks.shape, np.int64), np.arange(1 << BUCKET)
        for row, r, (present, upto, _, _) in zip(out, ranks, self._slide()):
            b = r >> BUCKET
            buckets = present.reshape(self.buckets, -1)[b]
            self.touched += buckets.size
            row[:] = np.append(0, upto)[b] + np.count_nonzero(buckets & (within < (r - (b << BUCKET))[:, None]), axis=1)
        return out

    def below(self, limit: np.ndarray, side: str = "left") -> np.ndarray:
        return self.counts_below(limit.reshape(-1, 1), side)[:, 0]

    def trapezoid_below(self, limit: np.ndarray) -> np.ndarray:
        ranks, out = np.searchsorted(self.values, limit), np.zeros(len(self.v))
        bucket = np.where(self.ranks >= 0, self.ranks >> BUCKET, -1)
        # the next position in the same bucket, and per bucket the first one of the window and the last one seen
        after, first = np.full(self.length, self.length), np.full(self.buckets, self.length)
        order = np.argsort(bucket, kind="stable")
        same = bucket[order][1:] == bucket[order][:-1]
        after[order[:-1][same]] = order[1:][same]
        np.minimum.at(first, bucket[self.at], self.at)
        last, sums = np.full(self.buckets, -1), np.zeros(self.buckets)
        for i, (r, (present, upto, gone, new)) in enumerate(zip(ranks, self._slide())):
            entered = self.at[new]  # in the order of positions
            last[new >> BUCKET] = entered
            first[gone >> BUCKET] = after[self.at[gone]]
            if i % REFRESH == 0:  # sums are moved on, and taken anew before rounding errors add up
                ranked = np.flatnonzero(present)
                sums = np.bincount(ranked >> BUCKET, self.values[ranked], self.buckets)
                self.touched += len(ranked) // REFRESH
            else:
                sums += np.bincount(new >> BUCKET, self.values[new], self.buckets) - np.bincount(gone >> BUCKET, self.values[gone], self.buckets)
            b = r >> BUCKET
            inside = (b << BUCKET) + np.flatnonzero(self._bucket(present, b)[:r - (b << BUCKET)])
            filled = np.flatnonzero(np.diff(upto[:b], prepend=0)) if b else np.empty(0, np.int64)
            n = (upto[b - 1] if b else 0) + len(inside)
            if n > 1:
                ends = np.concatenate([first[filled], last[filled], self.at[inside]])
                x = self.values[self.ranks[[ends.min(), ends.max()]]]
                out[i] = sums[filled].sum() + self.values[inside].sum() - x.sum() / 2
        return out

    def histogram(self, bins: int) -> np.ndarray:
        low, high = self.kth([np.zeros(len(self.v)), self.n - 1]).T
        edges = np.linspace(low, high, bins + 1, axis=1)[:, 1:-1]
        upto = np.column_stack([np.zeros(len(self.v)), self.counts_below(edges), self.n])
        out = np.diff(upto, axis=1)
        out[low == high] = np.append(self.n[low == high, None], np.zeros((int((low == high).sum()), bins - 1)), axis=1)  # one value, one bin
        return out


def _integral(w: Windows, q: float = 0.7) -> np.ndarray:
    return w.trapezoid_below(w.quantile(q))


def _binned_entropy(w: Windows, max_bins: int = 100) -> np.ndarray:
    p = w.histogram(max_bins) / np.reshape(w.n, (-1, 1))
    return -(p * np.log(np.where(p > 0, p, 1.0))).sum(1)


def _longest_run(flag: np.ndarray) -> np.ndarray:
    i = np.arange(flag.shape[1])
    return (i - np.maximum.accumulate(np.where(flag, -1, i), axis=1)).max(1)


def _con(w: Windows) -> np.ndarray:
    out = np.abs(w.v - w.mean) > 2 * w.std
    return (out[:, :-2] & out[:, 1:-1] & out[:, 2:]).sum(1) / (w.n - 2)


def _gskew(w: Windows) -> np.ndarray:
    """Median of the values up to P3, plus that of the values from P97, minus twice the median."""
    low, below_high = w.below(w.quantile(0.03), "right"), w.below(w.quantile(0.97))
    return w.median_of_ranks(0 * low, low) + w.median_of_ranks(below_high, w.n - below_high) - 2 * w.quantile(0.5)


def _median_brp(w: Windows) -> np.ndarray:
    low, high, median = *w.kth([0, w.n - 1]).T, w.quantile(0.5)
    buffer = (high - low) / 10
    return np.maximum(w.below(median + buffer) - w.below(median - buffer, "right"), 0) / w.n  # a constant window has no buffer


def _beyond(w: Windows, r: float = 2) -> np.ndarray:
    return w.by_chunk(lambda v: (np.abs(v - v.mean(1, keepdims=True)) > r * v.std(1, keepdims=True)).mean(1))


def _percentile_range(w: Windows, lo: float, hi: float) -> np.ndarray:
    return w.order_statistic(hi) - w.order_statistic(lo)


def _flux_ratios(w: Windows) -> np.ndarray:
    middle = sum(_percentile_range(w, lo, hi) for lo, hi in ((0.40, 0.60), (0.25, 0.75), (0.10, 0.90)))
    return middle / _percentile_range(w, 0.05, 0.95)


def _rcs(w: Windows) -> np.ndarray:
    walk = np.cumsum(w.v - w.mean, axis=1)
    return (walk.max(1) - walk.min(1)) / (w.n * w.std[:, 0])


def _close_by_strips(x: np.ndarray, m: int, tol: float) -> np.ndarray:
    """For each run of ``m`` values, how many runs differ by ``tol`` at most in every place."""
    runs = np.lib.stride_tricks.sliding_window_view(x, m)
    strip = max(1, CHUNK // len(runs))
    return np.concatenate([np.logical_and.reduce([np.abs(runs[i:i + strip, j, None] - runs[None, :, j]) <= tol for j in range(m)]).sum(1)
                           for i in range(0, len(runs), strip)])


class CloseSets:
    """For each position the set of positions whose values differ by a tolerance at most, as bits.

    In the order of values such a set is a range of ranks, the difference of two prefixes.  Prefixes are kept for every
    ``step``-th rank, and the rest is set bit by bit; runs of values agree where the shifted sets of their places meet.  So 64
    comparisons are one operation, whatever the tolerance.
    """

    def __init__(self, x: np.ndarray, tol: float):
        n = len(x)
        order = np.argsort(x, kind="stable")
        v = x[order]
        self.low, self.high = self._range(x, v, tol)
        self.n, self.words, self.step = n, (n + 63) // 64, max(256, n // 1024)
        self.word, self.bit = order >> 6, np.left_shift(np.uint64(1), (order & 63).astype(np.uint64))
        self.kept = np.zeros((n // self.step + 1, self.words), np.uint64)
        for i in range(1, len(self.kept)):
            self.kept[i] = self.kept[i - 1]
            at = slice((i - 1) * self.step, i * self.step)
            np.add.at(self.kept[i], self.word[at], self.bit[at])  # each bit is set once, so adding is setting

    @staticmethod
    def _range(x: np.ndarray, v: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
        """Ranks from, to of the values ``|v - x| <= tol``; the test itself decides, not a rounded sum."""
        n = len(v)
        low, high = np.searchsorted(v, x - tol, "left"), np.searchsorted(v, x + tol, "right")
        near = lambda i: np.abs(v[np.clip(i, 0, n - 1)] - x) <= tol
        while (move := (low > 0) & near(low - 1)).any():
            low = low - move
        while (move := (low < n) & ~near(low)).any():
            low = low + move
        while (move := (high < n) & near(high)).any():
            high = high + move
        while (move := (high > 0) & ~near(high - 1)).any():
            high = high - move
        return low, high

    def prefixes(self, ranks: np.ndarray) -> np.ndarray:
        base = ranks // self.step
        out = self.kept[base]
        count = ranks - base * self.step
        row = np.repeat(np.arange(len(ranks)), count)
        rank = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(base * self.step, count)
        np.add.at(out.reshape(-1), row * self.words + self.word[rank], self.bit[rank])
        return out

    def sets(self, start: int, stop: int) -> np.ndarray:
        return self.prefixes(self.high[start:stop]) ^ self.prefixes(self.low[start:stop])

    @staticmethod
    def shifted(bits: np.ndarray, k: int) -> np.ndarray:
        """Bit j of the result is bit j + k."""
        out = bits >> np.uint64(k)
        out[:, :-1] |= bits[:, 1:] << np.uint64(64 - k)
        return out

    def close_runs(self, m: int, strip: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """For each run of ``m`` values and of ``m + 1`` values (up to 64), how many runs are close to it."""
        short, long = [], []
        for i in range(0, self.n - m + 1, strip):
            rows = min(strip, self.n - m + 1 - i)
            sets = self.sets(i, min(i + rows + m, self.n))
            meet = sets[:rows]
            for k in range(1, m):
                meet = meet & self.shifted(sets[k:k + rows], k)
            short.append(np.bitwise_count(meet).sum(1, dtype=np.int64))
            rows = len(sets) - m
            long.append(np.bitwise_count(meet[:rows] & self.shifted(sets[m:], m)).sum(1, dtype=np.int64))
        return np.concatenate(short), np.concatenate(long)


MANY = 1024  # values from which sets of bits beat plain comparisons; both give the same counts


def _approximate_entropy(w: Windows, m: int = 3, r: float = 3.0) -> np.ndarray:
    """Difference of the mean log shares of close runs of ``m`` and of ``m + 1`` values."""
    if w.n <= m + 1:
        return np.zeros(len(w.v))

    def entropy(x: np.ndarray, tol: float) -> float:
        both = CloseSets(x, tol).close_runs(m) if MANY <= len(x) and m < 64 else [_close_by_strips(x, k, tol) for k in (m, m + 1)]
        a, b = (float(np.log(c / len(c)).mean()) for c in both)
        return abs(a - b)

    return np.array([entropy(x, r * sd) for x, sd in zip(w.v, w.std[:, 0])])


def _slotted_length(w: Windows) -> np.ndarray:
    """First lag whose mean cross product falls below 1/e of the mean square (none: undefined)."""
    d = w.v - w.mean
    power = np.abs(np.fft.rfft(d, 2 * w.n, axis=1)) ** 2
    acf = np.fft.irfft(power, axis=1)[:, :w.n] / (w.n - np.arange(w.n))
    below = acf < np.exp(-1) * acf[:, :1]
    return np.where(below.any(1), below.argmax(1), np.nan)


FLOAT, LONG, ARRAY = pa.float64(), pa.int64(), pa.list_(pa.float64())
OUTPUT_TYPES = {FLOAT: "double", LONG: "bigint", ARRAY: "array<double>"}

# name -> (output type, function of the windows and the parameters)
KERNELS: dict[str, tuple[pa.DataType, Callable[..., np.ndarray]]] = {
    "w_quantile": (FLOAT, lambda w, q=0.05: w.quantile(q)),
    "w_median": (FLOAT, lambda w: w.quantile(0.5)),
    "w_irq": (FLOAT, lambda w, lag=None: w.quantile(0.75) - w.quantile(0.25)),
    "w_q31": (FLOAT, lambda w: w.quantile(0.75) - w.quantile(0.25)),
    "w_integral": (FLOAT, _integral),
    "w_binned_entropy": (FLOAT, _binned_entropy),
    "w_count_above_mean": (LONG, lambda w: w.n - w.below(w.mean, "right")),
    "w_count_below_mean": (LONG, lambda w: w.below(w.mean)),
    "w_longest_strike_above_mean": (LONG, lambda w: _longest_run(w.v > w.mean)),
    "w_longest_strike_below_mean": (LONG, lambda w: _longest_run(w.v < w.mean)),
    "w_ratio_beyond_r_sigma": (FLOAT, _beyond),
    "w_con": (FLOAT, _con),
    "w_percent_difference_flux_percentile": (FLOAT, lambda w: _percentile_range(w, 0.05, 0.95) / w.quantile(0.5)),
    "w_flux_percentile_ratio_sum": (FLOAT, _flux_ratios),
    "w_gskew": (FLOAT, _gskew),
    "w_median_BRP": (FLOAT, _median_brp),
    "w_rcs": (FLOAT, _rcs),
    "w_approximate_entropy": (FLOAT, _approximate_entropy),
    "w_slottedA_length": (FLOAT, _slotted_length),
    "w_fft_rmean_last_5000": (FLOAT, lambda w, lag=None, k=5000: w.v @ spectral.tail_mean_weights(w.n, k)[0]),
    "w_fft_lmean_last_5000": (FLOAT, lambda w, lag=None, k=5000: w.v @ spectral.tail_mean_weights(w.n, k)[1]),
    "w_psd": (ARRAY, lambda w, fs=4e6: spectral.periodogram(w.v, fs)),
    "w_periodogram": (ARRAY, lambda w, fs=4e6, N=2000: spectral.periodogram(w.v, fs)[:, :N]),
    "w_spectrogram_downsampled": (ARRAY, lambda w, fs=4e6, nperseg=100, noverlap=20, mode="psd":
                                  spectral.downsampled_spectrogram(w.v, fs, nperseg, noverlap, mode)),
    "w_max_smoothed_periodogram": (FLOAT, lambda w, fs=4e6, window_length=101, polyorder=2, bins=50000:
                                   spectral.smooth(spectral.periodogram(w.v, fs), window_length, polyorder)[:, :bins].max(1)),
    "w_number_cwt_peaks": (LONG, lambda w, n=1: np.array([spectral.cwt_peaks(x, n) for x in w.v])),
}


# spectra: undefined where a value is missing
EVEN = {"w_fft_rmean_last_5000", "w_fft_lmean_last_5000", "w_psd", "w_periodogram", "w_spectrogram_downsampled", "w_max_smoothed_periodogram"}

# features of ranks, counts and sums: of sliding windows, with or without missing values, they never look at all values of a window
BY_RANK = {"w_quantile", "w_median", "w_irq", "w_q31", "w_integral", "w_count_above_mean", "w_count_below_mean", "w_binned_entropy",
           "w_percent_difference_flux_percentile", "w_flux_percentile_ratio_sum", "w_gskew", "w_median_BRP"}


def _windows(buf: np.ndarray, size: int, stride: int, limit: int) -> Iterator[tuple[int, Windows]]:
    """(index of the first window, windows) of one block; a partial tail comes by itself, last."""
    full = min(limit, (len(buf) - size) // stride + 1) if len(buf) >= size else 0
    if full > 1 and size >= LONG_WINDOW and stride * 4 <= size:
        yield 0, SlidingWindows(buf, size, stride, full)
    elif full:
        v = np.lib.stride_tricks.sliding_window_view(buf, size)[::stride][:full]
        step = max(1, CHUNK // size)
        for i in range(0, full, step):
            yield i, Windows(v[i:i + step])
    tail = len(buf) - full * stride
    if full < limit and max(0, size - stride) < tail < size:
        yield full, Windows(buf[None, full * stride:])


def _evaluate(w: Windows, op: str, params: dict, fn: Callable | None = None) -> np.ndarray | list:
    fn = fn or KERNELS[op][1]
    if op in BY_RANK or len(w.v) == 1:
        return fn(w, **params)
    return [y for part in w.chunks() for y in fn(part, **params)]


def _with_missing(w: Windows, missing: np.ndarray, op: str, params: dict, fn: Callable | None = None) -> list:
    """Windows that lack a value one by one (those that lack none as usual); None where nothing is left."""
    fn = fn or KERNELS[op][1]
    out: list = [None] * len(w.v)
    whole = np.flatnonzero(~missing)
    if len(whole):
        for i, y in zip(whole, _evaluate(Windows(w.v[whole]) if len(whole) < len(w.v) else w, op, params, fn)):
            out[i] = y
    for i in np.flatnonzero(missing):
        values = w.v[i][~np.isnan(w.v[i])]
        if len(values) and op not in EVEN:
            out[i] = fn(Windows(values[None, :]), **params)[0]
    return out


def _feature(w: Windows, missing: np.ndarray, op: str, params: dict, fn: Callable | None = None) -> np.ndarray | list:
    """A feature of all windows; ``missing`` tells which lack a value."""
    if not missing.any():
        return _evaluate(w, op, params, fn)
    if isinstance(w, SlidingWindows) and op in BY_RANK:
        values = (fn or KERNELS[op][1])(w, **params)
        return [y if n else None for y, n in zip(values.tolist(), w.n)]
    return _with_missing(w, missing, op, params, fn)


def _column(values: list | np.ndarray, kind: pa.DataType) -> pa.Array:
    if kind == ARRAY:
        return pa.array(list(values), ARRAY)
    if isinstance(values, list):
        values = [None if y is None or y != y else y for y in values]
    return pa.array(values if isinstance(values, list) else np.asarray(values), kind, from_pandas=True)


def block_features(f: Frame, ops: dict[str, tuple[str, dict]], size: int, stride: int, short: str) -> DataFrame:
    """Evaluate kernels over the windows that start in each block of a frame; one row per window."""
    fields = {name: KERNELS[op][0] for name, (op, _) in ops.items()}
    functions = {name: KERNELS[op][1] for name, (op, _) in ops.items()}  # looked up here: an executor has not seen own operators
    schema = pa.schema([(KEY, pa.string()), ("win", LONG), ("n", LONG), *fields.items()])
    block = f.size

    def evaluate(key, pos, x):
        sid, blk = key
        pos = pos - blk * block
        buf = np.full(int(pos.max()) + 1, np.nan)
        if len(pos) != len(buf) or len(np.unique(pos)) != len(pos):
            raise ValueError(f"series {sid!r} has gaps or doubled positions after {blk * block}")
        buf[pos] = x
        holes = np.append(0, np.cumsum(np.isnan(buf)))
        parts = []
        with np.errstate(all="ignore"):
            for first, w in _windows(buf, size, stride, block // stride):
                k = len(w.v)
                win = first + blk * (block // stride) + np.arange(k)
                if win[0] == 0 and w.size < size:
                    if short == "error":
                        raise ValueError(f"series {sid!r} has fewer than {size} rows")
                    continue
                cols = [pa.array([sid] * k, pa.string()), pa.array(win), pa.array([w.size] * k, LONG)]
                at = (first + np.arange(k)) * stride
                missing = holes[at + w.size] > holes[at]
                for name, (op, params) in ops.items():
                    cols.append(_column(_feature(w, missing, op, params, functions[name]), fields[name]))
                parts.append(pa.RecordBatch.from_arrays(cols, schema=schema))
        return pa.Table.from_batches(parts, schema=schema)

    start = F.col("blk") * block
    rows = f.df.filter((F.col("pos") >= start) & (F.col("pos") < start + block + max(0, size - stride)))
    out = f"{KEY} string, win bigint, n bigint, " + ", ".join(f"`{k}` {OUTPUT_TYPES[t]}" for k, t in fields.items())
    return per_block(rows, evaluate, out)
