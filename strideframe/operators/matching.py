"""Analogues of a probe value in a feature table, and of a template in a long signal."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import BLOCK_KEYS, block_size, halo, idiv, per_block
from ..functions.bins import digitize
from ..series import KEY
from ..tables import written

PART = 1 << 16  # rows of a template to an array


def analogues(df: DataFrame, value: str, probe: Column | float, low: float = -0.8, high: float = 0.6, steps: int = 100,
              atol: float = 1e-3, rtol: float = 1e-5) -> DataFrame:
    """Rows of ``df`` once per offset ``eps`` for which |probe + eps - value| <= atol + rtol |value|.

    ``eps`` runs over ``steps`` evenly spaced offsets.  The offsets a row can match follow from its
    value, so each row is expanded to its matches only (two candidates are added for rounding, and
    all are tested).
    """
    probe = F.lit(probe) if isinstance(probe, (int, float)) else probe
    step = (high - low) / (steps - 1)
    tol = F.lit(atol) + F.lit(rtol) * F.abs(value)
    centre = F.col(value) - F.col("_probe") - low
    first = F.greatest(F.ceil((centre - tol) / step) - 1, F.lit(0))
    last = F.least(F.floor((centre + tol) / step) + 1, F.lit(steps - 1))
    hits = (df.withColumn("_probe", probe).withColumn("_first", first).withColumn("_last", last)
            .filter("_first <= _last").withColumn("eps_id", F.explode(F.sequence("_first", "_last"))))
    eps = F.when(F.col("eps_id") == steps - 1, F.lit(high)).otherwise(F.col("eps_id") * step + low)
    return (hits.withColumn("eps", eps).filter(F.abs(F.col("_probe") + F.col("eps") - F.col(value)) <= tol)
            .drop("_probe", "_first", "_last"))


def analogue_labels(df: DataFrame, value: str, label: str, probe: Column | float, **grid) -> DataFrame:
    """Mean label of the analogues, per offset that has any."""
    hits = analogues(df, value, probe, **grid)
    return hits.groupBy("eps_id").agg(F.first("eps").alias("eps"), F.avg(label).alias("label"), F.count(F.lit(1)).alias("matches"))


def template_parts(template: DataFrame, size: int = PART) -> DataFrame:
    """``part, t``: the values of a template ``(pos, x)``, ``size`` rows to an array; a missing value counts as 0."""
    pair = F.struct("pos", F.coalesce("x", F.lit(0.0)).alias("x"))
    parts = template.groupBy(idiv("pos", size).alias("part")).agg(F.array_sort(F.collect_list(pair)).alias("t"))
    return parts.select("part", F.transform("t", lambda e: e["x"]).alias("t"))


def cross_correlation(s: DataFrame, template: DataFrame | np.ndarray, block: int | None = None, part: int = PART) -> DataFrame:
    """``series_id, pos, corr``: sum over j of x[pos + j] * template[j], wherever the template fits.

    Overlap-save: each halo block is correlated by one Fourier product of its own length.  A template is a table
    ``(pos, x)`` with positions from 0, of any length: it is cut into parts, which meet every block inside the plan, and whose
    correlations add up.
    """
    if isinstance(template, np.ndarray):
        template = s.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(template)], "pos bigint, x double")
    parts = written(template_parts(template, part), "template")
    count, length = parts.agg(F.count(F.lit(1)), F.sum(F.size("t"))).first()
    reach = min(length, part)
    f = halo(s.select(KEY, "pos", "x"), block_size(reach - 1, minimum=block), right=reach - 1)
    size = f.size
    schema = pa.schema([(KEY, pa.string()), ("pos", pa.int64()), ("corr", pa.float64())])
    packed = f.df.groupBy(*BLOCK_KEYS).agg(F.collect_list("pos").alias("pos"), F.collect_list(F.coalesce("x", F.lit(0.0))).alias("x"))
    packed = packed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))))
    pairs = packed.join(parts, "part").select(KEY, "blk", "part", "pos", "x", "t")

    def correlate(batches):
        for b in batches:
            for i in range(b.num_rows):
                sid, blk, k = (b.column(c)[i].as_py() for c in (KEY, "blk", "part"))
                pos, values, t = (b.column(c)[i].values.to_numpy() for c in ("pos", "x", "t"))
                x = np.zeros(int(pos.max()) - blk * size + 1)
                if len(pos) != len(x):
                    raise ValueError(f"series {sid!r} has gaps or doubled positions after {blk * size}")
                x[pos - blk * size] = values
                n = min(size, len(x) - len(t) + 1)
                if n > 0:
                    width = 1 << int(len(x) + len(t) - 1).bit_length()
                    corr = np.fft.irfft(np.fft.rfft(x, width) * np.conj(np.fft.rfft(t, width)), width)[:n]
                    yield pa.RecordBatch.from_arrays([pa.array([sid] * n, pa.string()), pa.array(blk * size + np.arange(n) - k * part), pa.array(corr)], schema=schema)

    out = pairs.mapInArrow(correlate, f"{KEY} string, pos bigint, corr double")
    if count > 1:  # every part has to fit
        out = out.filter("pos >= 0").groupBy(KEY, "pos").agg(F.sum("corr").alias("corr"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == count).drop("n")
    return out


def best_match(corr: DataFrame) -> DataFrame:
    """First position of the largest correlation, per series."""
    best = F.max(F.struct(F.col("corr"), (-F.col("pos")).alias("p"))).alias("b")
    return corr.groupBy(KEY).agg(best).select(KEY, (-F.col("b.p")).alias("pos"), F.col("b.corr").alias("corr"))


SPECTRA = 16  # spectra of template bins held at a time


def _occupied(x: np.ndarray) -> np.ndarray:
    return np.unique(x[~np.isnan(x)])


def shifts_are_cheaper(x: np.ndarray, b: np.ndarray, windows: int) -> bool:
    """Whether correlations take less time than counting ``windows`` windows one by one (in units of one counted row).

    A window costs its rows and as much as some 4,000 of them for the calls; a pair of bins costs one inverse transform.
    """
    width = 1 << int(len(x)).bit_length()
    pairs = len(_occupied(x)) * len(_occupied(b))
    return windows * (len(b) + 4_000) > pairs * (width * np.log2(width) / 12 + 2.5 * windows)


def information_of_shifts(x: np.ndarray, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Normalised mutual information of ``b`` with the window of ``x`` at each start; NaN where no row has both values.

    How often bin p of the signal meets bin q of the template is, for all shifts at once, the correlation of two arrays that are
    1 in those bins and 0 elsewhere.  Entropies need the sums of c log c over the pairs and over either side only, so that nothing is kept
    per pair.  The work is a transform per pair of occupied bins, whatever the length of a window or the step.
    """
    width = 1 << int(len(x)).bit_length()
    spectrum = lambda flags: np.fft.rfft(flags.astype(float), width)
    meet = lambda fx, fb: np.rint(np.fft.irfft(fx * np.conj(fb), width)[starts])
    clogc = lambda c: c * np.log(np.maximum(c, 1.0))
    some_x, some_b = spectrum(~np.isnan(x)), spectrum(~np.isnan(b))
    bins_x, bins_b = _occupied(x), _occupied(b)
    n = meet(some_x, some_b)
    joint, one, two, bins_one, bins_two = (np.zeros(len(starts)) for _ in range(5))
    for p in bins_x:
        c = meet(spectrum(x == p), some_b)
        one += clogc(c)
        bins_one += c > 0
    for at in range(0, len(bins_b), SPECTRA):
        held = [spectrum(b == q) for q in bins_b[at:at + SPECTRA]]
        for fb in held:
            c = meet(some_x, fb)
            two += clogc(c)
            bins_two += c > 0
        for p in bins_x:
            fx = spectrum(x == p)
            for fb in held:
                joint += clogc(meet(fx, fb))
    total = np.where(n > 0, n, np.nan)
    h1, h2, h12 = (np.log(total) - c / total for c in (one, two, joint))
    mi = h1 + h2 - h12
    varied = (bins_one > 1) & (bins_two > 1) & (mi > 2.220446049250313e-16)
    nmi = np.where(varied, mi / np.where(varied, (h1 + h2) / 2, 1.0), 0.0)
    nmi = np.where((bins_one == 1) & (bins_two == 1), 1.0, nmi)
    return np.where(n > 0, nmi, np.nan)


def template_information(s: DataFrame, template: DataFrame, size: int, step: int, low: float, high: float, width: float,
                         block: int | None = None) -> DataFrame:
    """``series_id, win, nmi``: normalised mutual information of a binned template of ``size`` rows with each window.

    Only windows that fit whole are scored, and the last start is excluded: starts are range(0, n - size, step).  Each halo
    block counts the joint bins of its windows; rows where the window or the template lacks a value are left out.  Where windows
    overlap so much that counting each of them costs more, the counts of all shifts come from correlations (the same counts).
    """
    k = int(np.ceil((high - low) / width))
    bins = lambda df: df.withColumn("x", digitize(F.col("x"), low, width, k).cast("double"))
    shape = bins(template).filter((F.col("pos") >= 0) & (F.col("pos") < size)).select("pos", "x").toPandas()  # one window
    b = np.full(size, np.nan)
    b[shape["pos"]] = shape["x"]
    f = halo(bins(s.select(KEY, "pos", "x")), block_size(size, step, block), right=size)
    rows = f.size
    schema = pa.schema([(KEY, pa.string()), ("win", pa.int64()), ("nmi", pa.float64())])

    def entropy(counts: np.ndarray) -> float:
        p = counts[counts > 0] / counts.sum()
        return float(-(p * np.log(p)).sum())

    def score(x: np.ndarray) -> float | None:
        there = ~(np.isnan(x) | np.isnan(b))
        if not there.any():
            return None
        joint = np.bincount((x[there] * (k + 1) + b[there]).astype(np.int64), minlength=(k + 1) ** 2).reshape(k + 1, k + 1)
        one, two = joint.sum(1), joint.sum(0)
        if np.count_nonzero(one) == 1 and np.count_nonzero(two) == 1:
            return 1.0
        h1, h2 = entropy(one), entropy(two)
        mi = h1 + h2 - entropy(joint.ravel())
        return mi / ((h1 + h2) / 2) if mi > 2.220446049250313e-16 else 0.0

    def scan(key, pos, values):
        sid, blk = key
        x = np.full(int(pos.max()) - blk * rows + 1, np.nan)
        if len(pos) != len(x):
            raise ValueError(f"series {sid!r} has gaps or doubled positions after {blk * rows}")
        x[pos - blk * rows] = values
        starts = np.arange(0, min(rows, max(0, len(x) - size)), step)  # a later row exists
        shifted = shifts_are_cheaper(x, b, len(starts))
        scores = information_of_shifts(x, b, starts) if shifted else [score(x[i:i + size]) for i in starts]
        return pa.Table.from_arrays([pa.array([sid] * len(starts), pa.string()), pa.array((blk * rows + starts) // step),
                                     pa.array(scores, pa.float64(), from_pandas=True)], schema=schema)

    return per_block(f.df, scan, f"{KEY} string, win bigint, nmi double")
