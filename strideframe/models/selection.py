"""Feature selection and feature quality over wide feature tables."""

from __future__ import annotations

from functools import reduce
from math import floor

import numpy as np
from pyspark.ml.feature import UnivariateFeatureSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.information import mutual_information, normalized_mutual_information
from ..operators.neighbours import neighbour_information
from ..operators.quantiles import exact_quantiles
from ..operators.rolling import rolled
from ..series import KEY, join_small
from ..tables import written
from . import moments
from .estimators import FEATURES, create_model
from .metrics import METRICS, score
from .runs import assemble_features, out_of_fold


def long_form(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``keep, feature, value``: all features under one another, so that one job treats them all."""
    return df.unpivot([F.col(c) for c in keep], [F.col(c).cast("double").alias(c) for c in columns], "feature", "value")


def quantile_bins(df: DataFrame, key: str, columns: dict[str, str], bins: int) -> DataFrame:
    """Add the equal-frequency bins ``{column: output}`` of values within their key: how many of the inner quantiles are <= value.

    The columns are stacked, so that one pass finds the quantiles of all.  The rows are read three
    times, and are written for that (they are a feature table, not a signal).
    """
    df = written(df, "rows")
    edges = [f"_q{i}" for i in range(1, bins)]
    stacked = df.unpivot([F.col(key)], [F.col(c).cast("double").alias(c) for c in columns], "_which", "_cell")
    cuts = exact_quantiles(stacked, [key, "_which"], "_cell", {e: (i + 1) / bins for i, e in enumerate(edges)})
    cuts = cuts.groupBy(key).agg(*[F.max(F.when(F.col("_which") == c, F.array(*edges))).alias("_cuts_" + c) for c in columns])
    below = lambda c: F.size(F.filter("_cuts_" + c, lambda q: q <= F.col(c)))
    return join_small(df, cuts, [key]).withColumns({out: below(c) for c, out in columns.items()}).drop(*["_cuts_" + c for c in columns])


def binned_information(df: DataFrame, columns: list[str], label: str, bins: int = 16, discrete_label: bool = False) -> DataFrame:
    """``feature, n, mi, nmi``: mutual information of every feature with the label, over equal-frequency bins."""
    rows = long_form(df, columns, [label]).filter(F.col("value").isNotNull() & F.col(label).isNotNull())
    if discrete_label:
        rows = quantile_bins(rows.withColumn("_b", F.col(label)), "feature", {"value": "_a"}, bins)
    else:
        rows = quantile_bins(rows, "feature", {"value": "_a", label: "_b"}, bins)
    return normalized_mutual_information(rows, ["feature"], "_a", "_b").select("feature", "n", "mi", "nmi")


def nearest_information(df: DataFrame, columns: list[str], label: str, k: int = 3, cell: int = 1024) -> DataFrame:
    """``feature, n, mi``: mutual information of every feature with a continuous label, from distances to the kth nearest neighbour."""
    return neighbour_information(long_form(df, columns, [label]), "feature", "value", label, k, cell)


def discrete_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency mutual information of two discrete columns, one row."""
    return mutual_information(df.select(F.lit("all").alias("_k"), a, b), ["_k"], a, b).drop("_k")


def ranked(scores: DataFrame, score: str, k: int | None = None) -> DataFrame:
    """Features by score, best first; ties by name."""
    out = scores.orderBy(F.col(score).desc(), "feature")
    return out if k is None else out.limit(k)


def names(ranking: DataFrame) -> list[str]:
    return [r["feature"] for r in ranking.select("feature").collect()]  # as many rows as features


def select_percentile(scores: DataFrame, score: str, percentile: float, columns: list[str]) -> list[str]:
    """The best ``percentile`` per cent of the features, in their table order."""
    best = set(names(ranked(scores, score, floor(percentile / 100 * len(columns)))))
    return [c for c in columns if c in best]


def f_regression(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """``feature, r, f``: correlation with the label and its F value, in one aggregate."""
    n = F.count(F.lit(1))
    stats = df.filter(F.col(label).isNotNull()).agg(n.alias("n"), *[F.corr(c, label).alias(c) for c in columns])
    rows = stats.unpivot([F.col("n")], [F.col(c) for c in columns], "feature", "r")
    return rows.select("feature", "r", (F.col("r") * F.col("r") / (1 - F.col("r") * F.col("r")) * (F.col("n") - 2)).alias("f"))


def univariate_selection(df: DataFrame, columns: list[str], label: str, mode: str, threshold: float) -> list[str]:
    """Modes ``numTopFeatures``, ``percentile`` (a share), ``fpr``, ``fdr`` and ``fwe``, by the F test."""
    selector = UnivariateFeatureSelector(featuresCol=FEATURES, labelCol="y", outputCol="s", selectionMode=mode)
    selector = selector.setFeatureType("continuous").setLabelType("continuous").setSelectionThreshold(threshold)
    model = selector.fit(assemble_features(df.filter(F.col(label).isNotNull()), columns, label))
    return [columns[i] for i in model.selectedFeatures]


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, variance`` (population)."""
    return df.agg(*[F.var_pop(c).alias(c) for c in columns]).unpivot([], [F.col(c) for c in columns], "feature", "variance")


def variance_threshold(df: DataFrame, columns: list[str], threshold: float = 0.16) -> list[str]:
    keep = set(names(variances(df, columns).filter(F.col("variance") > threshold)))
    return [c for c in columns if c in keep]


def importances(df: DataFrame, columns: list[str], label: str, model: str, params: dict) -> dict[str, float]:
    data = assemble_features(df.filter(F.col(label).isNotNull()), columns, label)
    fitted = create_model(model, params, data).fit(data)
    weights = fitted.featureImportances if hasattr(fitted, "featureImportances") else fitted.coefficients
    return {c: abs(float(w)) for c, w in zip(columns, weights.toArray())}


def eliminate(columns: list[str], keep: int, step: int, weights) -> list[list[str]]:
    """Subsets of falling size down to ``keep``; ``weights(columns)`` tells what each feature is worth among them."""
    subsets = [list(columns)]
    while len(subsets[-1]) > keep:
        left = subsets[-1]
        weight = weights(left)
        worst = sorted(left, key=lambda c: (weight[c], c))[:min(step, len(left) - keep)]
        subsets.append([c for c in left if c not in worst])
    return subsets


def linear_weights(m: moments.Moments, columns: list[str], model: str, params: dict):
    """Sizes of coefficients of any subset of the features, from one set of moments."""
    return lambda left: dict(zip(left, np.abs(moments.solve(m, columns, model, params, None, left).coefficients).tolist()))


def recursive_elimination(df: DataFrame, columns: list[str], label: str, keep: int, model: str = "DecisionTreeRegressor",
                          params: dict | None = None, step: int = 1) -> tuple[list[str], dict[str, int]]:
    """Drop the ``step`` least important features and refit, until ``keep`` are left.

    Returns the survivors and a ranking (1 for survivors, larger for features dropped earlier).  Linear models are refitted from
    moments: one pass over the rows, whatever the number of steps.
    """
    if model in moments.LINEAR:
        weights = linear_weights(moments.moments(df, columns, label, ())[()], columns, model, params or {})
    else:
        df = written(df.select(*columns, label), "rows")
        weights = lambda left: importances(df, left, label, model, params or {})
    subsets = eliminate(columns, keep, step, weights)
    dropped = [set(a) - set(b) for a, b in zip(subsets, subsets[1:])]
    ranking = dict.fromkeys(subsets[-1], 1) | {c: i + 2 for i, cs in enumerate(reversed(dropped)) for c in cs}
    return subsets[-1], ranking


def recursive_elimination_cv(folds: DataFrame, columns: list[str], label: str, model: str, params: dict, step: int = 10,
                             minimum: int = 1, metric: str = "mean_absolute_error") -> tuple[list[str], list[tuple[int, float]]]:
    """Elimination whose size is chosen by leakage-safe folds.

    Each fold ranks the features by its own training rows and scores every size on its test rows; the size with the least mean
    loss (the smaller of equals) is then reached on all rows.  Returns that subset and (size, score) of every size tried.
    Linear models need two passes in all.
    """
    folds = folds.filter(F.col(label).isNotNull())
    numbers = sorted(r["fold"] for r in folds.select("fold").distinct().collect())
    if model in moments.LINEAR:
        trained = moments.moments(folds.filter("role = 'train'"), columns, label, ("fold",))
        subsets = {k: eliminate(columns, minimum, step, linear_weights(trained[k,], columns, model, params)) for k in numbers}
        lines = [{k: moments.solve(trained[k,], columns, model, params, use=subsets[k][i]) for k in numbers} for i in range(len(subsets[numbers[0]]))]
        predicted = moments.predicted(folds.filter("role = 'test'"), lines, label).withColumnRenamed("model", "size")
    else:
        rows = {k: written(folds.filter((F.col("fold") == k) & (F.col("role") != "pad")), "fold") for k in numbers}
        subsets = {k: eliminate(columns, minimum, step, lambda left, k=k: importances(rows[k].filter("role = 'train'"), left, label, model, params)) for k in numbers}
        parts = [out_of_fold(rows[k], left, model, params, label=label).filter("role = 'test'").withColumn("size", F.lit(i)) for k in numbers for i, left in enumerate(subsets[k])]
        predicted = reduce(DataFrame.unionByName, parts)
    scores = score(predicted, [metric], ["size", "fold"]).groupBy("size").agg(F.avg(metric).alias("loss")).collect()  # a row per size
    tried = [(len(subsets[numbers[0]][r["size"]]), r["loss"]) for r in sorted(scores, key=lambda r: r["size"])]
    best = min(tried, key=lambda t: (t[1], t[0]))[0]
    left, _ = recursive_elimination(folds.filter(F.col("fold") == numbers[0]), columns, label, best, model, params, step)
    return left, tried


def two_stage_elimination(df: DataFrame, label: str, percentile: float, num_of_features: int, model: str = "DecisionTreeRegressor",
                          params: dict | None = None, columns: list[str] | None = None, bins: int = 16, neighbours: int | None = None) -> DataFrame:
    """Keep a percentile of the features by mutual information, then eliminate recursively; the label is not in the output.

    The information is counted over ``bins``, or estimated from the nearest ``neighbours`` where that is given.
    """
    columns = columns or [c for c in df.columns if c != label]
    if floor(percentile / 100 * len(columns)) < num_of_features:
        raise ValueError("the first stage would leave fewer features than wanted: choose a greater percentile or fewer features")
    scores = nearest_information(df, columns, label, neighbours) if neighbours else binned_information(df, columns, label, bins)
    first = select_percentile(scores, "mi", percentile, columns)
    left, _ = recursive_elimination(df, first, label, num_of_features, model, params)
    return df.select(*left)


def lasso_selection(df: DataFrame, columns: list[str], label: str, alpha: float) -> list[str]:
    """Features with a non-zero coefficient under an L1 penalty."""
    weight = importances(df, columns, label, "Lasso", {"alpha": alpha})
    return [c for c in columns if weight[c] > 1e-10]


def importance_selection(df: DataFrame, columns: list[str], label: str, model: str = "RandomForestRegressor", params: dict | None = None) -> list[str]:
    """Features at least as important as the average one."""
    weight = importances(df, columns, label, model, params or {})
    mean = sum(weight.values()) / len(weight)
    return [c for c in columns if weight[c] >= mean]


def parameter_sweep(tables: dict[float, DataFrame], value: str, label: str, bins: int = 16) -> DataFrame:
    """``param, mi, nmi``: information of one feature with the label, for each parameter value that was tried.

    ``tables`` maps a parameter to its feature table; all are scored by one aggregation.
    """
    stacked = None
    for param, df in tables.items():
        part = df.select(F.lit(str(param)).alias("param"), F.col(value).cast("double").alias("value"), F.col(label).alias("label"))
        stacked = part if stacked is None else stacked.unionByName(part)
    rows = stacked.filter(F.col("value").isNotNull() & F.col("label").isNotNull())
    rows = quantile_bins(rows, "param", {"value": "_a", "label": "_b"}, bins)
    return normalized_mutual_information(rows, ["param"], "_a", "_b").select(F.col("param").cast("double").alias("param"), "mi", "nmi")


def feature_quality(df: DataFrame, columns: list[str], window_length: int = 10001, polyorder: int = 2, order: str = "win") -> DataFrame:
    """``feature, rmse, l1, non_linearity`` of each feature, clipped to its 1-99 % quantiles and standardised.

    ``rmse`` and ``l1`` measure the distance to the smoothed feature, ``non_linearity`` the distance to a
    standardised ramp or its mirror image, whichever is nearer.  The features become the series of one
    series table, so that one clip, one smoothing and one aggregate serve all.
    """
    s = long_form(df, columns, [order]).select(F.col("feature").alias(KEY), F.col(order).alias("pos"), F.col("value").alias("x"))
    s = written(rolled(written(s, "features"), [("r_clip", {})]), "clipped")
    stats = s.groupBy(KEY).agg(F.avg("x").alias("a"), F.stddev_pop("x").alias("b"), F.count(F.lit(1)).cast("double").alias("n"))
    z = (F.col("x") - F.col("a")) / F.when(F.col("b") == 0, 1.0).otherwise(F.col("b"))
    s = join_small(s, stats, [KEY]).select(KEY, "pos", "n", z.alias("x"), z.alias("raw"))
    # smoothing leaves the other columns alone, so the value itself rides along
    both = rolled(s, [("r_savgol_filter", {"window_length": window_length, "polyorder": polyorder})]).withColumnsRenamed({"x": "y", "raw": "x"})
    # a ramp 0..1 over n rows has mean 1/2 and population variance (n+1) / (12 (n-1))
    line = (F.col("pos") / (F.col("n") - 1) - 0.5) / F.sqrt((F.col("n") + 1) / (12 * (F.col("n") - 1)))
    x, y, total = F.col("x"), F.col("y"), F.first("n")
    norm = lambda e: F.sqrt(F.sum(e * e)) / total * 100
    return both.groupBy(F.col(KEY).alias("feature")).agg(
        norm(x - y).alias("rmse"), (F.abs(F.sum(x - y)) / total).alias("l1"), F.least(norm(x - line), norm(x + line)).alias("non_linearity"))


def repeated_scores(predictions: dict[int, DataFrame], metric: str) -> DataFrame:
    """Median of a score over repeated predictions ``{repeat: DataFrame(y, prediction)}``."""
    parts = None
    for r, df in predictions.items():
        one = df.agg(METRICS[metric](F.col("y"), F.col("prediction")).alias(metric))
        parts = one if parts is None else parts.unionByName(one)
    return parts.agg(F.median(metric).alias(metric))
