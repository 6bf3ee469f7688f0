"""Feature tables from a declarative list of operator chains.

A feature is ``{"name": ..., "on": True, "functions": {operator: params, ...}}``: row operators
(``r_*``) and window operators (``w_*``) applied left to right.  Where an operator may repeat,
``functions`` can also be a list of ``(operator, params)`` pairs.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kernels import ARRAY, KERNELS
from ..operators.resample import resample_to
from ..operators.rolling import ROW_OPS, rolled
from ..operators.windows import assemble, is_window_op, window_features
from ..series import KEY

MAX_NAME = 250


def truncated_name(name: str) -> str:
    """Names are cut after 250 characters and end in two dots."""
    return name[:MAX_NAME] + ".." if name else name


def steps_of(feature: dict, window_size: int, window_stride: int) -> list[tuple[str, dict]]:
    """Operators of one chain with the default window filled in.

    Every operator that takes a ``window_size`` gets the global one unless it names its own; this
    includes the moving mean and deviation.  Row operators have no stride.
    """
    functions = feature["functions"]
    steps = []
    for op, params in functions.items() if isinstance(functions, dict) else functions:
        params = dict(params)
        if is_window_op(op):
            params["window_size"] = params.get("window_size", window_size)
            params["window_stride"] = params.get("window_stride", window_stride)
        elif op in ("r_mean", "r_std"):
            params.pop("window_stride", None)
            params["window_size"] = params.get("window_size", window_size)
        elif op == "r_clip" or op in ROW_OPS:
            for name in ("window_size", "window_stride"):
                params.pop(name, None)
        else:
            raise KeyError(f"unknown operator {op!r} in feature {feature.get('name')!r}")
        steps.append((op, params))
    return steps


def enabled(features: list[dict], window_size: int, window_stride: int) -> dict[str, list[tuple[str, dict]]]:
    """Chains by name, without the disabled ones; a repeated name gets the suffix _2, _3, ..."""
    chains: dict[str, list] = {}
    for feature in features:
        if not feature.get("on", True):
            continue
        name, k = feature["name"], 1
        while name in chains:
            k += 1
            name = f"{feature['name']}_{k}"
        chains[name] = steps_of(feature, window_size, window_stride)
    if not chains:
        raise ValueError("no feature is switched on")
    return chains


def _split(chain: list) -> tuple[list, tuple | None, list]:
    """Leading row operators, the first window operator, and the rest."""
    for i, (op, params) in enumerate(chain):
        if is_window_op(op):
            return chain[:i], (op, params), chain[i + 1:]
    return chain, None, []


def _frozen(x) -> str:
    return json.dumps(x, sort_keys=True)


def _tables(s: DataFrame, chains: dict[str, list], short: str) -> list[tuple[DataFrame, list[str], tuple]]:
    """(table, its feature columns, signature of its row grid) per group of chains.

    Chains that start with the same row operators and window share one pass over the signal; what
    follows the first window works on its (S times smaller) output.
    """
    groups: dict[str, dict[str, list]] = {}
    for name, chain in chains.items():
        rows, window, _ = _split(chain)
        grid = None if window is None else (window[1]["window_size"], window[1]["window_stride"])
        groups.setdefault(_frozen([rows, grid]), {})[name] = chain
    out = []
    for members in groups.values():
        rows, window, _ = _split(next(iter(members.values())))
        if window is None:
            df = rolled(s.select(KEY, "pos", "x"), rows)
            for name in members:
                out.append((df.select(KEY, F.col("pos").alias("win"), F.col("x").alias(name)), [name], ("rows",)))
            continue
        size, stride = window[1]["window_size"], window[1]["window_stride"]
        first, columns = {}, {}
        for name, chain in members.items():
            op, params = _split(chain)[1]
            own = {k: v for k, v in params.items() if k not in ("window_size", "window_stride")}
            columns[name] = first.setdefault(_frozen([op, own]), (f"f{len(first)}", op, own))[0]
        table = window_features(s, {col: (op, own) for col, op, own in first.values()}, size, stride, rows=rows, short=short)
        done = [n for n, chain in members.items() if not _split(chain)[2]]
        if done:
            out.append((table.select(KEY, "win", *[F.col(columns[n]).alias(n) for n in done]), done, (size, stride)))
        rest: dict[str, dict[str, list]] = {}
        for name, chain in members.items():
            if name not in done:
                rest.setdefault(columns[name], {})[name] = _split(chain)[2]
        for col, tails in rest.items():
            inner = table.select(KEY, F.col("win").alias("pos"), F.col(col).cast("double").alias("x"))
            out += [(t, names, (size, stride) if sig == ("rows",) else (size, stride, *sig))
                    for t, names, sig in _tables(inner, tails, short)]
    return out


def build_features(s: DataFrame, features: list[dict], window_size: int, window_stride: int, short: str = "error") -> DataFrame:
    """``series_id, win, <one column per feature>[, ttf]``: one row per default window.

    Features on another grid (other window, window over window, plain rows) are resampled by linear
    interpolation to the number of default windows of their series.  With a ``ttf`` column in the
    series, the last label of each default window is attached.
    """
    chains = enabled(features, window_size, window_stride)
    tables = _tables(s, chains, short)
    on_grid = [t for t, _, sig in tables if sig == (window_size, window_stride)]
    if "ttf" in s.columns:
        label = window_features(s, {}, window_size, window_stride, label=True, short=short)
        grid = label.select(KEY, "win")
    else:
        label = None
        grid = (on_grid[0] if on_grid else window_features(s, {"n": ("w_min", {})}, window_size, window_stride, short=short)).select(KEY, "win")
    parts = on_grid + [resample_to(t, names, grid) for t, names, sig in tables if sig != (window_size, window_stride)]
    parts += [label] if label is not None else []
    return assemble(parts, [KEY, "win"]).select(KEY, "win", *chains, *(["ttf"] if label is not None else []))


def build_feature(s: DataFrame, features: list[dict], name: str, window_size: int, window_stride: int, short: str = "error") -> DataFrame:
    """Only the feature called ``name``, on its own grid (no resampling, no label)."""
    found = [f for f in features if f["name"] == name]
    if not found:
        raise KeyError(f"no feature {name!r}")
    (table, _, _), = _tables(s, {name: steps_of(found[0], window_size, window_stride)}, short)
    return table


def is_array_feature(chain: list[tuple[str, dict]]) -> bool:
    op = chain[-1][0]
    return op in KERNELS and KERNELS[op][0] == ARRAY


def widen(df: DataFrame, column: str, size: int) -> DataFrame:
    """Replace an array feature by the columns ``<name>_0 .. <name>_<size-1>``."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, *[F.get(column, F.lit(i)).alias(f"{column}_{i}") for i in range(size)])


def smooth_columns(df: DataFrame, columns: list[str], window_length: int = 10001, polyorder: int = 2, order: str = "win") -> DataFrame:
    """Savitzky-Golay smoothing of every feature column of a table, down its rows (per series, if it names one).

    The columns are stacked into the series of one series table, smoothed together, and spread out again.
    """
    keys = [KEY, order] if KEY in df.columns else [order]
    long = df.unpivot([F.col(k) for k in keys], [F.col(c).cast("double").alias(c) for c in columns], "_feature", "x")
    index = F.array_position(F.array(*map(F.lit, columns)), F.col("_feature")) - 1
    stacked = F.concat_ws("\x1f", *[k for k in keys if k == KEY], index.cast("string")).alias(KEY)
    smooth = rolled(long.select(stacked, F.col(order).alias("pos"), "x"), [("r_savgol_filter", {"window_length": window_length, "polyorder": polyorder})])
    number = F.substring_index(KEY, "\x1f", -1)
    own = F.substring(F.col(KEY), F.lit(1), F.length(KEY) - F.length(number) - 1).alias(KEY)
    smooth = smooth.select(*[own] * (KEY in keys), number.cast("int").alias("_feature"), F.col("pos").alias(order), "x")
    wide = smooth.groupBy(*keys).agg(*[F.max(F.when(F.col("_feature") == i, F.col("x"))).alias(c) for i, c in enumerate(columns)])
    others = [c for c in df.columns if c not in columns]
    return df.select(*others).join(wide, keys).select(*df.columns)


GRID_WINDOWS = (11, 101, 1001, 10001)
GRID_ROW_OPS = ("r_std", "r_mean", "r_sta_lta")
GRID_WINDOW_OPS = ("w_median", "w_mean", "w_min", "w_max", "w_binned_entropy", "w_quantile", "w_kurtosis", "w_skewness", "w_q31",
                   "w_ratio_beyond_r_sigma", "w_median_BRP", "w_autocorrelation", "w_count_above_mean", "w_mean_abs_change",
                   "w_mean_change")


def feature_grid(windows=GRID_WINDOWS, row_ops=GRID_ROW_OPS, window_ops=GRID_WINDOW_OPS) -> list[dict]:
    """All chains (moving operator at each window) -> (window operator)."""

    def params(op: str, w: int) -> dict:
        return {"sta_window": w, "lta_window": 10 * w} if op == "r_sta_lta" else {"window_size": w}

    return [{"name": f"{row}_{w}_{win}", "on": True, "functions": {row: params(row, w), win: {}}}
            for w in windows for row in row_ops for win in window_ops]


def spec_key(features: list[dict], window_size: int, window_stride: int, source: str) -> str:
    """Content hash of a feature table: same input and same full spec, same key."""
    return hashlib.sha256(_frozen([source, features, window_size, window_stride]).encode()).hexdigest()
