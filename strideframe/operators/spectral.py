"""Fourier helpers on the rows of a 2-D array of windows (used inside grouped Arrow functions)."""

from __future__ import annotations

import numpy as np


def tail_mean_weights(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights whose dot product with x is the mean real / imaginary part of its last k Fourier bins.

    The mean over bins n-K..n-1 of exp(-2 pi i j f / n) is a geometric sum, so no transform is needed.
    """
    k, j = min(k, n), np.arange(n)
    half = np.pi * j / n
    with np.errstate(all="ignore"):
        size = np.where(j == 0, 1.0, np.sin(k * half) / (k * np.sin(half)))
    return size * np.cos(half * (k + 1)), size * np.sin(half * (k + 1))


def periodogram(v: np.ndarray, fs: float, taper: np.ndarray | None = None) -> np.ndarray:
    """One-sided power density of the mean-free signal along the last axis."""
    n = v.shape[-1]
    taper = np.ones(n) if taper is None else taper
    p = np.abs(np.fft.rfft((v - v.mean(-1, keepdims=True)) * taper)) ** 2 / (fs * (taper ** 2).sum())
    p[..., 1:(-1 if n % 2 == 0 else None)] *= 2  # all bins but zero and Nyquist stand for two
    return p


def tukey(n: int, alpha: float = 0.25) -> np.ndarray:
    """Periodic tapered-cosine window."""
    edge = alpha * n / 2
    k = np.minimum(np.arange(n), n - np.arange(n))
    return np.where(k < edge, (1 - np.cos(np.pi * k / edge)) / 2, 1.0)


def downsampled_spectrogram(v: np.ndarray, fs: float, nperseg: int, noverlap: int, mode: str = "psd") -> np.ndarray:
    """Short-time power density, three times averaged over 4 bins and thinned to every 4th, frames in a row."""
    if mode != "psd":
        raise ValueError(f"spectrogram mode {mode!r} is not supported")
    frames = np.lib.stride_tricks.sliding_window_view(v, nperseg, axis=1)[:, ::nperseg - noverlap]
    p = periodogram(frames, fs, tukey(nperseg))
    for _ in range(3):
        padded = np.pad(p, ((0, 0), (0, 0), (3, 3)))
        p = np.lib.stride_tricks.sliding_window_view(padded, 4, axis=2).mean(-1)[:, :, ::4]
    return p.reshape(len(v), -1)


def smooth(p: np.ndarray, window_length: int, polyorder: int) -> np.ndarray:
    """Savitzky-Golay along the last axis, polynomial ends."""
    h = window_length // 2
    k = np.arange(-h, h + 1)
    fit = np.linalg.pinv(np.vander(k / h, polyorder + 1, increasing=True))
    at = np.vander(k / h, polyorder + 1, increasing=True)
    out = np.empty_like(p)
    for row, y in zip(p, out):
        y[h:-h] = np.convolve(row, fit[0][::-1], "valid")
        y[:h] = (at @ (fit @ row[:window_length]))[:h]
        y[-h:] = (at @ (fit @ row[-window_length:]))[-h:]
    return out


def _ricker(points: int, a: float) -> np.ndarray:
    t2 = ((np.arange(points) - (points - 1) / 2) / a) ** 2
    return 2 / (np.sqrt(3 * a) * np.pi ** 0.25) * (1 - t2) * np.exp(-t2 / 2)


def cwt_peaks(x: np.ndarray, n: int) -> int:
    """Peaks of x that persist over Ricker wavelets of widths 1..n, with a signal-to-noise ratio of 1 at least.

    A ridge starts at a local maximum of the widest scale and is followed to narrower ones, each time
    to the nearest maximum within a quarter of the width; it may miss one scale.
    """
    widths = np.arange(1, n + 1)
    scales = np.array([np.convolve(x, _ricker(min(10 * a, len(x)), a)[::-1], "same") for a in widths])
    peak = np.zeros(scales.shape, bool)
    peak[:, 1:-1] = (scales[:, 1:-1] > scales[:, :-2]) & (scales[:, 1:-1] > scales[:, 2:])
    has = np.flatnonzero(peak.any(1))
    if not len(has):
        return 0
    live = [([has[-1]], [at], 0) for at in np.flatnonzero(peak[has[-1]])]
    done = []
    for row in range(has[-1] - 1, -1, -1):
        tips = np.array([cols[-1] for _, cols, _ in live])
        live = [(rows, cols, gap + 1) for rows, cols, gap in live]
        for at in np.flatnonzero(peak[row]):
            near = np.abs(at - tips).argmin() if len(tips) else None
            if near is not None and abs(at - tips[near]) <= widths[row] / 4:
                rows, cols, _ = live[near]
                rows.append(row)
                cols.append(at)
                live[near] = (rows, cols, 0)
            else:
                live.append(([row], [at], 0))
        done += [r for r in live if r[2] > widths[0]]
        live = [r for r in live if r[2] <= widths[0]]
    half, odd = divmod(int(np.ceil(len(x) / 20)), 2)
    count = 0
    for rows, cols, _ in done + live:
        if len(rows) < np.ceil(len(widths) / 4):
            continue
        tip, top = cols[-1], scales[rows[-1], cols[-1]]
        noise = np.percentile(scales[0, max(tip - half, 0):min(tip + half + odd, len(x))], 10)
        with np.errstate(all="ignore"):
            count += bool(abs(top / noise) >= 1)
    return count
