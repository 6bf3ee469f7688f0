"""Trees grown by aggregates: second-order boosting on binned features, and extremely randomised trees.

Rows stay on the executors.  Per level of a tree each task adds up its own rows by (node, feature, bin), Spark adds the tasks'
sums, picks the best cut of every node with a running sum over the bins, and only one row per open node reaches the driver.
The models of all folds grow side by side in the same jobs (``fit_folds``), so folds cost rows but no further passes.

Trees are heaps: node 1 is the root, node ``i`` has the children ``2 i`` (left, ``x < cut``) and ``2 i + 1``.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

FEATURES, LABEL = "features", "y"
ACCURACY = 100_000  # of the quantiles that cut a feature into bins; exact up to about as many rows


class Tree:
    """Split features (-1: a leaf), raw cuts, cuts as bins, values and gains by node."""

    def __init__(self, depth: int):
        self.depth, size = depth, 2 << depth
        self.feature = np.full(size, -1, np.int64)
        self.cut, self.value, self.gain = np.zeros(size), np.zeros(size), np.zeros(size)
        self.bin = np.zeros(size, np.int64)

    def split(self, node: int, feature: int, cut: float, bin: int = 0, gain: float = 0.0) -> None:
        self.feature[node], self.cut[node], self.bin[node], self.gain[node] = feature, cut, bin, gain

    def nodes(self, x: np.ndarray, binned: bool = False) -> np.ndarray:
        """The node that each row of a matrix (of values, or of bin numbers) has come to."""
        node, rows = np.ones(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            f = self.feature[node]
            at = x[rows, np.maximum(f, 0)]
            right = at > self.bin[node] if binned else at >= self.cut[node]
            node = np.where(f >= 0, 2 * node + right, node)
        return node

    def to_json(self) -> dict:
        return {"depth": self.depth, **{k: getattr(self, k).tolist() for k in ("feature", "cut", "value", "gain")}}

    @classmethod
    def from_json(cls, d: dict) -> "Tree":
        tree = cls(d["depth"])
        for k in ("feature", "cut", "value", "gain"):
            getattr(tree, k)[:] = d[k]
        return tree


class Trees:
    """A sum of trees over a base value."""

    def __init__(self, base: float, width: int, trees: list[Tree]):
        self.base, self.width, self.trees = base, width, trees

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.value[tree.nodes(x)]
        return out

    def importances(self) -> np.ndarray:
        """Gains per feature, summing to 1."""
        total = np.zeros(self.width)
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(total, tree.feature[inner], tree.gain[inner])
        return total / total.sum() if total.sum() else total

    def to_json(self) -> dict:
        return {"base": self.base, "width": self.width, "trees": [t.to_json() for t in self.trees]}

    @classmethod
    def from_json(cls, d: dict) -> "Trees":
        return cls(d["base"], d["width"], [Tree.from_json(t) for t in d["trees"]])


class TreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees by group, as a stage that can be saved with a pipeline."""

    groups = Param(Params._dummy(), "groups", "trees by group, as JSON", typeConverter=TypeConverters.toString)

    def __init__(self, groups: dict[int, Trees] | None = None, group: str | None = None):
        super().__init__()
        if groups is not None:
            self._set(groups=json.dumps({"group": group, "trees": {str(g): t.to_json() for g, t in groups.items()}}))

    def fitted(self) -> tuple[str | None, dict[int, Trees]]:
        d = json.loads(self.getOrDefault(self.groups))
        return d["group"], {int(g): Trees.from_json(t) for g, t in d["trees"].items()}

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802  (as Spark's own models call it)
        return DenseVector(np.mean([t.importances() for t in self.fitted()[1].values()], axis=0))

    def _transform(self, df: DataFrame) -> DataFrame:
        group, trees = self.fitted()

        @F.pandas_udf("double")
        def predict(g: pd.Series, x: pd.Series) -> pd.Series:
            out = np.full(len(x), np.nan)
            for k in g.unique():
                at = (g == k).to_numpy()
                out[at] = trees[int(k)].predict(np.stack(x[at].to_numpy()))
            return pd.Series(out)

        return df.withColumn("prediction", predict(F.col(group).cast("int") if group else F.lit(0), vector_to_array(FEATURES)))


# rows of a training table as arrays


def matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """A binary column of rows of equal length, as one matrix."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0]:at[-1]].view(dtype).reshape(-1, width)


def as_binary(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def by_group(grp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for g in np.unique(grp):
        yield int(g), np.flatnonzero(grp == g)


def uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """A draw in [0, 1) for each row id: the same wherever and whenever it is made."""
    with np.errstate(over="ignore"):
        z = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % (1 << 63)) * np.uint64(0xD1B54A32D192ED03)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(float) / (1 << 53)


def training_rows(df: DataFrame, group: str | None) -> tuple[DataFrame, int]:
    """``grp, id, y, x`` written once, and the number of features."""
    grp = F.col(group).cast("int") if group else F.lit(0)
    rows = df.select(grp.alias("grp"), F.col(LABEL).cast("double").alias("y"), vector_to_array(FEATURES).alias("x"))
    rows = written(rows.withColumn("id", F.monotonically_increasing_id()), "tree-rows")
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("there are no rows to train on")
    return rows, first["n"]


class Boosted(Estimator):
    """Boosting of depth-wise trees with second-order gains.

    A node with gradient sum G and curvature sum H has the value ``-eta G / (H + reg_lambda)``; a cut gains
    ``(GL^2 / (HL + reg_lambda) + GR^2 / (HR + reg_lambda) - G^2 / (H + reg_lambda)) / 2 - gamma`` and is made if that is positive and
    both sides have a curvature of at least ``min_child_weight``.  ``absolute`` takes the sign of the error as gradient and 1
    as curvature, otherwise the loss is half the square.  ``subsample`` draws rows and ``colsample_bytree`` features, for each tree, by ``seed``.
    Cuts are the ``max_bins``-quantiles of a feature; equal gains go to the first feature and the lowest cut.
    """

    def __init__(self, eta: float = 0.1, max_depth: int = 3, n_estimators: int = 100, min_child_weight: float = 1.0, gamma: float = 0.0,
                 reg_lambda: float = 1.0, subsample: float = 1.0, colsample_bytree: float = 1.0, seed: int = 0, absolute: bool = False,
                 max_bins: int = 256, base_score: float | None = None):
        super().__init__()
        for name, v, low in (("max_depth", max_depth, 1), ("n_estimators", n_estimators, 1), ("max_bins", max_bins, 2)):
            if int(v) != v or v < low:
                raise ValueError(f"{name} must be a whole number from {low} on, not {v!r}")
        for name, v in (("subsample", subsample), ("colsample_bytree", colsample_bytree)):
            if not 0 < v <= 1:
                raise ValueError(f"{name} must be in (0, 1], not {v!r}")
        self.eta, self.max_depth, self.n_estimators, self.min_child_weight, self.gamma = eta, int(max_depth), int(n_estimators), min_child_weight, gamma
        self.reg_lambda, self.subsample, self.colsample_bytree, self.seed = reg_lambda, subsample, colsample_bytree, int(seed)
        self.absolute, self.max_bins, self.base_score = absolute, int(max_bins), base_score

    def _fit(self, df: DataFrame) -> TreesModel:
        return TreesModel(self.grow(df, None))

    def fit_folds(self, df: DataFrame, group: str) -> TreesModel:
        """One model per value of ``group``, all in the same jobs; the model looks its trees up by that column."""
        return TreesModel(self.grow(df, group), group)

    def grow(self, df: DataFrame, group: str | None) -> dict[int, Trees]:
        rows, width = training_rows(df, group)
        shares = [i / self.max_bins for i in range(1, self.max_bins)]
        middle = F.percentile_approx("y", 0.5, ACCURACY) if self.absolute else F.avg("y")
        stats = rows.groupBy("grp").agg(middle.alias("base"), *[F.percentile_approx(F.col("x")[j], shares, ACCURACY).alias(f"q{j}") for j in range(width)]).collect()  # one row per group
        cuts = {r["grp"]: [np.unique(r[f"q{j}"]) for j in range(width)] for r in stats}
        models = {r["grp"]: Trees(r["base"] if self.base_score is None else self.base_score, width, []) for r in stats}
        rows = self.binned(rows, cuts, {g: m.base for g, m in models.items()})
        for turn in range(self.n_estimators):
            trees = self.tree(rows, sorted(models), width, cuts, turn)
            for g, tree in trees.items():
                models[g].trees.append(tree)
            if turn + 1 < self.n_estimators:
                rows = self.moved(rows, trees, width)
        return models

    @property
    def kind(self):
        return np.uint8 if self.max_bins <= 256 else np.uint16

    def binned(self, rows: DataFrame, cuts: dict, base: dict[int, float]) -> DataFrame:
        kind = self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                grp = b.column(0).to_numpy()
                x = b.column(3).flatten().to_numpy().reshape(b.num_rows, -1)
                out, margin = np.zeros(x.shape, kind), np.zeros(len(x))
                for g, at in by_group(grp):
                    margin[at] = base[g]
                    for j, edges in enumerate(cuts[g]):
                        out[at, j] = np.searchsorted(edges, x[at, j], side="right")
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(margin), as_binary(out)], names=["grp", "id", "y", "margin", "x"])

        return written(rows.select("grp", "id", "y", "x").mapInArrow(run, "grp int, id bigint, y double, margin double, x binary"), "boosting")

    def moved(self, rows: DataFrame, trees: dict[int, Tree], width: int) -> DataFrame:
        kind = self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x, margin = matrix(b.column(4), kind, width), b.column(3).to_numpy().copy()
                for g, at in by_group(b.column(0).to_numpy()):
                    margin[at] += trees[g].value[trees[g].nodes(x[at], binned=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(margin), b.column(4)], names=["grp", "id", "y", "margin", "x"])

        return written(rows.mapInArrow(run, "grp int, id bigint, y double, margin double, x binary"), "boosting")

    def sums(self, rows: DataFrame, trees: dict[int, Tree], open_nodes: dict[int, list[int]], level: int, width: int, features: list[int], turn: int) -> DataFrame:
        """``grp, node, feature, bin, g, h``: gradient and curvature sums over the rows in open nodes."""
        kind, bins, absolute, share, seed = self.kind, self.max_bins, self.absolute, self.subsample, self.seed * 1_000_003 + turn
        schema = pa.schema([("grp", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("g", pa.float64()), ("h", pa.float64())])
        columns = np.array(features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                x, y, margin = matrix(b.column(4), kind, width), b.column(2).to_numpy(), b.column(3).to_numpy()
                drawn = uniform(b.column(1).to_numpy(), seed) < share if share < 1 else np.ones(len(y), bool)
                for g, at in by_group(b.column(0).to_numpy()):
                    at = at[drawn[at]]
                    place = np.full(2 << level, -1)
                    place[open_nodes[g]] = np.arange(len(open_nodes[g]))
                    node = place[trees[g].nodes(x[at], binned=True)]
                    at, node = at[node >= 0], node[node >= 0]
                    if not len(at):
                        continue
                    error = margin[at] - y[at]
                    grad = np.sign(error) if absolute else error
                    size = len(open_nodes[g]) * len(columns) * bins
                    index = ((node[:, None] * len(columns) + np.arange(len(columns))) * bins + x[at][:, columns]).ravel()
                    sums = total.setdefault(g, np.zeros((2, size)))
                    sums[0] += np.bincount(index, np.repeat(grad, len(columns)), size)
                    sums[1] += np.bincount(index, minlength=size)
            for g, sums in total.items():
                at = np.flatnonzero(sums[1])
                node = np.array(open_nodes[g])[at // (len(columns) * bins)]
                cells = [np.full(len(at), g), node, columns[at // bins % len(columns)], at % bins]
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in cells), pa.array(sums[0, at]), pa.array(sums[1, at])], schema=schema)

        parts = rows.mapInArrow(run, "grp int, node int, feature int, bin int, g double, h double")
        # a task has summed its rows already, so one exchange by feature serves the sums and the running sums
        return parts.repartition("grp", "node", "feature").groupBy("grp", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))

    def best_cuts(self, sums: DataFrame) -> DataFrame:
        """``grp, node, best``: per node the totals, and the cut with the greatest gain (null where no cut is allowed)."""
        cell = Window.partitionBy("grp", "node", "feature")
        upto = cell.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        d = sums.select("grp", "node", "feature", "bin", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"),
                        F.sum("g").over(cell).alias("gt"), F.sum("h").over(cell).alias("ht"))
        score = lambda g, h: g * g / (h + self.reg_lambda)
        gl, hl, gr, hr = F.col("gl"), F.col("hl"), F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
        allowed = (hr > 0) & (hl >= self.min_child_weight) & (hr >= self.min_child_weight)
        gain = F.when(allowed, (score(gl, hl) + score(gr, hr) - score(F.col("gt"), F.col("ht"))) / 2 - self.gamma)
        d = d.withColumn("gain", gain)
        rank = F.struct("gain", -F.col("feature"), -F.col("bin"))
        return d.groupBy("grp", "node").agg(F.max_by(F.struct("feature", "bin", "gain", "gl", "hl", "gt", "ht"), rank).alias("best"))

    def tree(self, rows: DataFrame, groups: list[int], width: int, cuts: dict, turn: int) -> dict[int, Tree]:
        """The next tree of every group."""
        features = list(range(width))
        if self.colsample_bytree < 1:
            features = sorted(random.Random(f"{self.seed}|{turn}").sample(features, max(1, int(self.colsample_bytree * width))))
        trees = {g: Tree(self.max_depth) for g in groups}
        totals = {g: {1: (0.0, 0.0)} for g in groups}
        open_nodes = {g: [1] for g in groups}
        for level in range(self.max_depth):
            found = self.best_cuts(self.sums(rows, trees, open_nodes, level, width, features, turn)).collect()  # a row per open node
            open_nodes = {g: [] for g in groups}
            for r in found:
                g, node, best = r["grp"], r["node"], r["best"]
                totals[g][node] = (best["gt"], best["ht"])
                if best["gain"] is not None and best["gain"] > 0:
                    trees[g].split(node, best["feature"], float(cuts[g][best["feature"]][best["bin"]]), best["bin"], best["gain"])
                    totals[g][2 * node] = (best["gl"], best["hl"])
                    totals[g][2 * node + 1] = (best["gt"] - best["gl"], best["ht"] - best["hl"])
                    open_nodes[g] += [2 * node, 2 * node + 1]
            if not any(open_nodes.values()):
                break
        for g, tree in trees.items():
            for node, (grad, weight) in totals[g].items():
                if weight > 0:
                    tree.value[node] = -self.eta * grad / (weight + self.reg_lambda)
        return trees


class ExtraTrees(Estimator):
    """Extremely randomised trees: a node draws one cut per feature between its smallest and largest value, and takes the one
    that reduces the squared error most.  All trees of all groups grow together, with two aggregates per level: the ranges of
    the open nodes, then the sums left of the drawn cuts.  Draws depend on (seed, tree, node, feature) alone.
    """

    def __init__(self, n_estimators: int = 20, max_depth: int = 5, min_samples_leaf: int = 1, max_features: float = 1.0, random_state: int = 0):
        super().__init__()
        self.n_estimators, self.max_depth, self.min_samples_leaf, self.max_features, self.seed = n_estimators, max_depth, min_samples_leaf, max_features, random_state

    def _fit(self, df: DataFrame) -> TreesModel:
        return TreesModel(self.grow(df, None))

    def fit_folds(self, df: DataFrame, group: str) -> TreesModel:
        return TreesModel(self.grow(df, group), group)

    def draw(self, tree: int, node: int, feature: int, low: float, high: float) -> float:
        """A cut in (low, high]: neither side is empty."""
        return high - random.Random(f"{self.seed}|{tree}|{node}|{feature}").random() * (high - low)

    def tried(self, tree: int, node: int, width: int) -> list[int]:
        return sorted(random.Random(f"{self.seed}|{tree}|{node}").sample(range(width), max(1, int(self.max_features * width))))

    def grow(self, df: DataFrame, group: str | None) -> dict[int, Trees]:
        rows, width = training_rows(df, group)
        groups = [r["grp"] for r in rows.select("grp").distinct().collect()]
        trees = {(g, t): Tree(self.max_depth) for g in groups for t in range(self.n_estimators)}
        open_nodes = {k: [1] for k in trees}
        for level in range(self.max_depth + 1):
            ranges: dict = {}
            for r in self.ranges(rows, trees, open_nodes, level).collect():  # trees x open nodes x features
                ranges.setdefault((r["grp"], r["tree"], r["node"]), {})[r["feature"]] = r
            cuts = {}
            for (g, t, node), of in ranges.items():
                any_feature = of[0]
                trees[g, t].value[node] = any_feature["s"] / any_feature["n"]
                if level < self.max_depth and any_feature["n"] >= 2 * self.min_samples_leaf:
                    own = {f: self.draw(t, node, f, of[f]["low"], of[f]["high"]) for f in self.tried(t, node, width) if of[f]["low"] < of[f]["high"]}
                    if own:
                        cuts[g, t, node] = own
            open_nodes = {k: [] for k in trees}
            if not cuts:
                break
            best: dict = {}
            for r in self.left_sums(rows, trees, cuts).collect():
                key, n, s = (r["grp"], r["tree"], r["node"]), r["n"], r["s"]
                whole = ranges[key][0]
                rest = whole["n"] - n
                if min(n, rest) >= self.min_samples_leaf:
                    gain = s * s / n + (whole["s"] - s) ** 2 / rest - whole["s"] ** 2 / whole["n"]
                    if key not in best or (gain, -r["feature"]) > best[key][:2]:
                        best[key] = gain, -r["feature"]
            for (g, t, node), (gain, feature) in best.items():
                if gain > 0:
                    trees[g, t].split(node, -feature, cuts[g, t, node][-feature], gain=gain)
                    open_nodes[g, t] += [2 * node, 2 * node + 1]
        out = {g: Trees(0.0, width, [trees[g, t] for t in range(self.n_estimators)]) for g in groups}
        for tree in trees.values():
            tree.value /= self.n_estimators  # the mean of the trees
        return out

    def ranges(self, rows: DataFrame, trees: dict, open_nodes: dict, level: int) -> DataFrame:
        """``grp, tree, node, feature, low, high, n, s`` of the open nodes."""
        schema = pa.schema([(c, pa.int32()) for c in ("grp", "tree", "node", "feature")] + [(c, pa.float64()) for c in ("low", "high", "n", "s")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x, y = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1), b.column(1).to_numpy()
                width = x.shape[1]
                for g, at in by_group(b.column(0).to_numpy()):
                    for t in sorted(t for k, t in trees if k == g):
                        node = trees[g, t].nodes(x[at])
                        order = np.flatnonzero(np.isin(node, open_nodes[g, t]))
                        if not len(order):
                            continue
                        order = order[np.argsort(node[order], kind="stable")]
                        first = np.flatnonzero(np.append(True, np.diff(node[order]) > 0))
                        values, labels = x[at[order]], y[at[order]]
                        k = len(first)
                        per_node = lambda a: np.repeat(a, width)
                        n, s = np.diff(np.append(first, len(order))), np.add.reduceat(labels, first)
                        cells = [np.full(k * width, g), np.full(k * width, t), per_node(node[order][first]), np.tile(np.arange(width), k)]
                        yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in cells), pa.array(np.minimum.reduceat(values, first).ravel()),
                                                          pa.array(np.maximum.reduceat(values, first).ravel()), pa.array(per_node(n).astype(float)), pa.array(per_node(s))], schema=schema)

        parts = rows.select("grp", "y", "x").mapInArrow(run, "grp int, tree int, node int, feature int, low double, high double, n double, s double")
        return parts.groupBy("grp", "tree", "node", "feature").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("s").alias("s"))

    def left_sums(self, rows: DataFrame, trees: dict, cuts: dict) -> DataFrame:
        """``grp, tree, node, feature, n, s`` of the rows left of each drawn cut."""
        schema = pa.schema([(c, pa.int32()) for c in ("grp", "tree", "node", "feature")] + [(c, pa.float64()) for c in ("n", "s")])
        by_tree: dict = {}
        for (g, t, node), own in cuts.items():
            by_tree.setdefault(g, {}).setdefault(t, {})[node] = own

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x, y, found = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1), b.column(1).to_numpy(), []
                for g, at in by_group(b.column(0).to_numpy()):
                    for t, nodes in by_tree.get(g, {}).items():
                        node = trees[g, t].nodes(x[at])
                        for k, own in nodes.items():
                            here = at[node == k]
                            for f, cut in own.items() if len(here) else ():
                                left = x[here, f] < cut
                                found.append((g, t, k, f, float(left.sum()), float(y[here][left].sum())))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, s.type) for c, s in zip(zip(*found), schema)], schema=schema)

        parts = rows.select("grp", "y", "x").mapInArrow(run, "grp int, tree int, node int, feature int, n double, s double")
        return parts.groupBy("grp", "tree", "node", "feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
