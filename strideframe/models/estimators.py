"""Regression models by name."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written
from .boosting import FEATURES, LABEL, Boosted, ExtraTrees

DEVICE_OPTIONS = {"nthread", "n_jobs", "num_threads", "thread_count", "gpu_id", "tree_method", "predictor", "device", "device_type", "task_type", "verbosity", "verbose", "silent"}
COMMON = {"featuresCol": FEATURES, "labelCol": LABEL}


def _linear(**kw) -> Estimator:
    # the normal equations up to 4,096 features, iterations with the same penalty beyond
    return LinearRegression(**COMMON, solver="auto", standardization=False, **kw)


def _ridge(alpha: float = 1.0, n: int | None = None, label_std: float | None = None) -> Estimator:
    """Penalty alpha |w|^2 beside the sum of squares.

    Spark's objective divides the sum of squares by 2n and, for the normal solver, measures the
    penalty in units of the label's deviation; ``n`` and ``label_std`` undo both.
    """
    if n is None or label_std is None:
        raise ValueError("ridge needs the number of training rows and the deviation of their label")
    return _linear(regParam=alpha * label_std / n, elasticNetParam=0.0)


def _lasso(alpha: float = 1.0) -> Estimator:
    return LinearRegression(**COMMON, solver="auto", standardization=False, regParam=alpha, elasticNetParam=1.0, maxIter=1000, tol=1e-9)


#: The libraries' names of one parameter.
ALIASES = {"learning_rate": "eta", "iterations": "n_estimators", "num_boost_round": "n_estimators", "depth": "max_depth", "min_split_loss": "gamma", "min_split_gain": "gamma",
           "lambda": "reg_lambda", "l2_leaf_reg": "reg_lambda", "random_state": "seed", "random_seed": "seed", "rsm": "colsample_bytree", "colsample_bytree": "colsample_bytree",
           "bagging_fraction": "subsample", "feature_fraction": "colsample_bytree", "max_bin": "max_bins", "border_count": "max_bins"}
LOSSES = {"absolute": {"reg:absoluteerror", "gpu:reg:absoluteerror", "regression_l1", "l1", "mae", "MAE", "lad", "absolute_error"},
          "squared": {"reg:linear", "gpu:reg:linear", "reg:squarederror", "regression", "regression_l2", "l2", "mse", "rmse", "RMSE", "ls", "squared_error"}}


def _boosted(reg_lambda: float) -> Callable[..., Estimator]:
    """Second-order boosted trees under the parameter names of the usual libraries.

    Device and thread options do not apply, and a metric to watch (``eval_metric``) changes no tree; any other parameter that
    the trees do not have is an error.  ``reg_lambda`` is the library's own default.
    """

    def build(**params) -> Estimator:
        own, absolute = {"reg_lambda": reg_lambda}, False
        for k, v in params.items():
            if k in ("objective", "loss_function", "loss", "criterion") and v in LOSSES["absolute"] | LOSSES["squared"]:
                absolute = v in LOSSES["absolute"]
            elif k in ("booster", "boosting_type") and v in ("gbtree", "gbdt") or k in DEVICE_OPTIONS or k == "eval_metric":
                continue
            else:
                own[ALIASES.get(k, k)] = v
        return Boosted(**own, absolute=absolute)

    return build


def _tree(max_depth: int = 5, min_samples_leaf: int = 1, random_state: int = 0) -> Estimator:
    return DecisionTreeRegressor(**COMMON, maxDepth=max_depth, minInstancesPerNode=min_samples_leaf, seed=random_state)


def _forest(n_estimators: int = 20, max_depth: int = 5, random_state: int = 0, max_features: str = "auto") -> Estimator:
    return RandomForestRegressor(**COMMON, numTrees=n_estimators, maxDepth=max_depth, seed=random_state, featureSubsetStrategy=max_features)


class AdaBoostR2:
    """AdaBoost.R2 with linear loss: each round fits a tree to weighted rows and raises the weights of the rows it misses; the
    prediction is the weighted median of the trees.  Weights are a column; each round's are written to the shared folder.
    """

    def __init__(self, n_estimators: int = 50, learning_rate: float = 1.0, max_depth: int = 3, seed: int = 0):
        self.n_estimators, self.learning_rate, self.max_depth, self.seed = n_estimators, learning_rate, max_depth, seed

    def fit(self, df: DataFrame) -> "AdaBoostR2Model":
        rows = written(df.select(FEATURES, LABEL, F.lit(1.0).alias("w")), "weights")
        trees, votes = [], []
        for i in range(self.n_estimators):
            tree = DecisionTreeRegressor(**COMMON, weightCol="w", maxDepth=self.max_depth, maxBins=256, seed=self.seed + i).fit(rows)
            missed = tree.transform(rows).withColumn("e", F.abs(F.col(LABEL) - F.col("prediction")))
            worst, loss, total = missed.agg(F.max("e"), F.sum(F.col("w") * F.col("e")), F.sum("w")).first()
            if not worst:  # a perfect tree decides alone
                return AdaBoostR2Model([tree], [1.0])
            loss /= worst * total
            if loss >= 0.5 and trees:
                break
            beta = loss / (1 - loss)
            trees.append(tree)
            votes.append(self.learning_rate * math.log(1 / beta) if loss < 0.5 else 1.0)
            if loss >= 0.5:
                break
            weight = F.col("w") * F.pow(F.lit(beta), self.learning_rate * (1 - F.col("e") / worst)) / total
            rows = written(missed.select(FEATURES, LABEL, weight.alias("w")), "weights")
        return AdaBoostR2Model(trees, votes)


class AdaBoostR2Model:
    def __init__(self, trees: list, votes: list[float]):
        self.trees, self.votes = trees, votes

    def transform(self, df: DataFrame) -> DataFrame:
        columns = df.columns
        for i, tree in enumerate(self.trees):
            df = tree.copy({tree.predictionCol: f"_p{i}"}).transform(df)
        pairs = F.array_sort(F.array(*[F.struct(F.col(f"_p{i}").alias("p"), F.lit(v).alias("v")) for i, v in enumerate(self.votes)]))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("p"))
        step = lambda a, x: F.struct((a["sum"] + x["v"]).alias("sum"), F.coalesce(a["p"], F.when(a["sum"] + x["v"] >= sum(self.votes) / 2, x["p"])).alias("p"))
        return df.select(*columns, F.aggregate(pairs, start, step)["p"].alias("prediction"))


MODELS: dict[str, Callable[..., Estimator]] = {
    "LinearRegression": _linear, "Ridge": _ridge, "Lasso": _lasso,
    "DecisionTreeRegressor": _tree, "RandomForestRegressor": _forest,
    "ExtraTreeRegressor": lambda n_estimators=1, **kw: ExtraTrees(n_estimators, **kw), "ExtraTreesRegressor": ExtraTrees,
    "GradientBoostingRegressor": _boosted(0.0), "XGBRegressor": _boosted(1.0), "LGBMRegressor": _boosted(0.0), "CatBoostRegressor": _boosted(3.0),
    "AdaBoostRegressor": lambda n_estimators=50, learning_rate=1.0, random_state=0, max_depth=3: AdaBoostR2(n_estimators, learning_rate, max_depth, random_state),
}


def register_model(name: str, build: Callable[..., Estimator]) -> None:
    """Add an own model: ``build(**params)`` returns a Spark ML estimator over (features, y)."""
    MODELS[name] = build


def create_model(name: str, params: dict, train: DataFrame | None = None) -> Estimator:
    if name not in MODELS:
        raise KeyError(f"unknown model {name!r}")
    if name == "Ridge" and train is not None:
        n, sd = train.agg(F.count(F.lit(1)), F.stddev_pop(LABEL)).first()
        params = {**params, "n": n, "label_std": sd}
    return MODELS[name](**params)


def binned_classifier(features: int, hidden: list[int], classes: int = 16, max_iter: int = 100, seed: int = 0) -> Estimator:
    """Perceptron over label bins; a prediction is turned back into a label by ``class_centre``."""
    return MultilayerPerceptronClassifier(featuresCol=FEATURES, labelCol="bin", layers=[features, *hidden, classes], maxIter=max_iter, seed=seed)


def class_centre(prediction: str = "prediction"):
    return F.col(prediction) + 0.5


def ensemble_mean(columns: list[str]):
    return sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)
