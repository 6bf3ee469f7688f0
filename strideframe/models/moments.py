"""Linear models of all folds from sufficient statistics.

One pass adds up the products of (1, features, label) per fold and role: (k + 2)^2 / 2 numbers each.  Scaling, any number of
penalties and any subset of the features are then algebra on these numbers, and one more pass predicts for all of them.  Sums are
taken of values less those of some row, so that large offsets do not cancel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINEAR = ("LinearRegression", "Ridge", "Lasso")


@dataclass(frozen=True)
class Moments:
    """Sums of products over the rows of a fold and role, and the range of each column; columns are (1, features, label)."""

    shift: np.ndarray
    products: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def n(self) -> float:
        return self.products[0, 0]

    @property
    def mean(self) -> np.ndarray:
        """Means of the features and the label."""
        return self.products[0, 1:] / self.n

    @property
    def covariance(self) -> np.ndarray:
        return self.products[1:, 1:] / self.n - np.outer(self.mean, self.mean)


@dataclass(frozen=True)
class Line:
    """``intercept + sum of coefficients * columns``."""

    columns: list[str]
    coefficients: np.ndarray
    intercept: float


def moments(df: DataFrame, columns: list[str], label: str, keys: tuple[str, ...] = ("fold", "role")) -> dict[tuple, Moments]:
    """Moments per key group.  An undefined feature is an error, a row without label is left out."""
    cells = [*columns, label]
    rows = df.filter(F.col(label).isNotNull()).select(F.concat_ws("|", *keys).alias("_key") if keys else F.lit("").alias("_key"), *keys, *[F.col(c).cast("double").alias(c) for c in cells])
    first = rows.select(*cells).first()
    if first is None:
        raise ValueError("there are no labelled rows")
    shift = np.array([0.0 if v is None or v != v else v for v in first])
    k, size = len(keys), len(cells) + 1
    upper = np.triu_indices(size)
    schema = pa.schema([("_key", pa.string()), ("at", pa.int32()), ("s", pa.float64()), ("lo", pa.float64()), ("hi", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1 + k:]])
            if np.isnan(x).any():
                raise ValueError("a feature is undefined in some row: fill or drop such rows first")
            x = np.column_stack([np.ones(len(x)), x - shift])
            names = b.column(0).to_numpy(zero_copy_only=False)
            for name in np.unique(names):
                own = x[names == name]
                held = total.setdefault(name, [np.zeros((size, size)), np.full(size, np.inf), np.full(size, -np.inf)])
                held[0] += own.T @ own
                np.minimum(held[1], own.min(0), out=held[1])
                np.maximum(held[2], own.max(0), out=held[2])
        for name, (products, lo, hi) in total.items():
            m = len(upper[0])
            yield pa.RecordBatch.from_arrays([pa.array([name] * m), pa.array(np.arange(m, dtype=np.int32)), pa.array(products[upper]),
                                              pa.array(np.resize(np.append(lo, np.zeros(m)), m)), pa.array(np.resize(np.append(hi, np.zeros(m)), m))], schema=schema)

    parts = rows.mapInArrow(run, "_key string, at int, s double, lo double, hi double")
    sums = parts.groupBy("_key", "at").agg(F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas()  # folds x roles x (k + 2)^2 / 2 rows
    out = {}
    for name, own in sums.sort_values("at").groupby("_key"):
        products = np.zeros((size, size))
        products[upper] = own["s"].to_numpy()
        products = products + np.triu(products, 1).T
        key = tuple(int(v) if v.lstrip("-").isdigit() else v for v in name.split("|")) if keys else ()
        out[key] = Moments(shift, products, own["lo"].to_numpy()[:size], own["hi"].to_numpy()[:size])
    return out


def solve(m: Moments, columns: list[str], model: str, params: dict, scaler: str | None = "StandardScaler", use: list[str] | None = None) -> Line:
    """Fit a linear model from moments, over the features ``use`` (all by default).

    ``Ridge`` minimises the sum of squares plus ``alpha |w|^2``, ``Lasso`` the mean square over two plus ``alpha |w|_1``, both in scaled
    units and with a free intercept.  Features that others determine share the least solution.
    """
    unknown = set(params) - ({"alpha"} if model != "LinearRegression" else set())
    if unknown:
        raise TypeError(f"{model} has no parameter {', '.join(sorted(unknown))}")
    use = columns if use is None else use
    at = np.array([columns.index(c) for c in use], int)
    cov, mean = m.covariance, m.mean
    scale = np.ones(len(at))
    if scaler == "StandardScaler":
        scale = np.sqrt(np.maximum(np.diag(cov)[at], 0))
    elif scaler == "MinMaxScaler":
        scale = (m.high - m.low)[1:][at]
    elif scaler is not None:
        raise KeyError(f"unknown scaler {scaler!r}")
    scale = np.where(scale > 0, scale, 1.0)
    z, c, alpha = cov[np.ix_(at, at)] / np.outer(scale, scale), cov[at, -1] / scale, params.get("alpha", 1.0)
    if model == "LinearRegression":
        w = np.linalg.lstsq(z, c, rcond=1e-12)[0]
    elif model == "Ridge":
        w = np.linalg.lstsq(z * m.n + alpha * np.eye(len(at)), c * m.n, rcond=None)[0]
    elif model == "Lasso":
        w = descent(z, c, alpha)
    else:
        raise KeyError(f"{model!r} is no linear model")
    w = w / scale
    return Line(use, w, float(m.shift[-1] + mean[-1] - w @ (m.shift[at] + mean[at])))


def descent(z: np.ndarray, c: np.ndarray, alpha: float, sweeps: int = 10_000, tolerance: float = 1e-12) -> np.ndarray:
    """Coordinate descent on ``w'zw / 2 - c'w + alpha |w|_1``."""
    w = np.zeros(len(c))
    for _ in range(sweeps):
        before = w.copy()
        for j in range(len(c)):
            if z[j, j] > 0:
                rest = c[j] - z[j] @ w + z[j, j] * w[j]
                w[j] = np.sign(rest) * max(abs(rest) - alpha, 0.0) / z[j, j]
        if np.abs(w - before).max(initial=0) <= tolerance * max(1.0, np.abs(w).max(initial=0)):
            break
    return w


def fit_folds(folds: DataFrame, columns: list[str], models: list[tuple[str, dict]], label: str, scaler: str | None) -> list[dict[int, Line]]:
    """For each model its line per fold, all from one pass over the training rows."""
    trained = moments(folds.filter(F.col("role") == "train"), columns, label, ("fold",))
    return [{fold: solve(m, columns, model, params, scaler) for (fold,), m in sorted(trained.items())} for model, params in models]


def prediction(lines: dict[int, Line]):
    """The prediction of each fold's line, as a column."""
    columns = sorted({c for line in lines.values() for c in line.columns})
    weights = {fold: dict(zip(line.columns, line.coefficients.tolist())) for fold, line in lines.items()}
    per_fold = lambda value: F.element_at(F.create_map(*[F.lit(x) for fold, v in value.items() for x in (int(fold), float(v))]), F.col("fold").cast("int"))
    out = per_fold({fold: line.intercept for fold, line in lines.items()})
    for c in columns:
        out = out + per_fold({fold: w.get(c, 0.0) for fold, w in weights.items()}) * F.col(c)
    return out


def predicted(folds: DataFrame, lines: list[dict[int, Line]], label: str) -> DataFrame:
    """``model, fold, role, pos, y, prediction`` for any number of models (numbered from 0), in one pass over the rows."""
    rows = folds.filter((F.col("role") != "pad") & F.col(label).isNotNull())
    all_models = F.array(*[prediction(of) for of in lines])
    return rows.select("fold", "role", "pos", F.col(label).cast("double").alias("y"), F.posexplode(all_models).alias("model", "prediction"))
