"""Training runs: folds x models x metrics, their summary rows, and scoring of segments."""

from __future__ import annotations

import json
import random

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import ElementwiseProduct, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import metric_columns
from ..series import KEY
from ..tables import written
from . import moments, scaling
from .estimators import FEATURES, LABEL, create_model
from .metrics import score


def assemble_features(df: DataFrame, columns: list[str], label: str = "ttf") -> DataFrame:
    """The features as one vector; a row with an undefined feature is an error (fill or drop such rows by choice, not in silence)."""
    df = df.withColumn(LABEL, F.col(label).cast("double")) if label in df.columns else df
    return VectorAssembler(inputCols=columns, outputCol=FEATURES, handleInvalid="error").transform(df)


def prepared_folds(folds: DataFrame, columns: list[str], scaler: str | None = "StandardScaler", label: str = "ttf") -> DataFrame:
    """``fold, role, pos, y, features``, scaled by each fold's training rows: written once, for any number of models."""
    df = folds.filter(F.col("role") != "pad").filter(F.col(label).isNotNull())
    if scaler:
        df = scaling.scale_folds(df, columns, scaler)
    df = assemble_features(df, columns, label).select("fold", "role", "pos", LABEL, FEATURES)
    return written(df, "folds")


def out_of_fold(folds: DataFrame, columns: list[str], model: str, params: dict, scaler: str | None = "StandardScaler",
                label: str = "ttf") -> DataFrame:
    """Predictions of every fold's model for its own train and test rows: ``fold, role, pos, y, prediction``.

    Linear models are fitted to all folds from one pass over the training rows; the rows themselves are neither scaled nor copied.
    """
    if model in moments.LINEAR:
        lines = moments.fit_folds(folds.filter(F.col(label).isNotNull()), columns, [(model, params)], label, scaler)
        return moments.predicted(folds, lines, label).drop("model")
    return fold_predictions(prepared_folds(folds, columns, scaler, label), model, params)


def fold_predictions(df: DataFrame, model: str, params: dict) -> DataFrame:
    """The same from prepared folds.  A model that can fit all folds side by side does; otherwise the driver loops over them."""
    train = df.filter(F.col("role") == "train")
    whole = create_model(model, params, train)
    if hasattr(whole, "fit_folds"):
        return whole.fit_folds(train, "fold").transform(df).select("fold", "role", "pos", LABEL, "prediction")
    parts = []
    for (fold,) in sorted(df.select("fold").distinct().collect()):
        rows = df.filter(F.col("fold") == fold)
        train = rows.filter(F.col("role") == "train")
        fitted = create_model(model, params, train).fit(train)
        parts.append(fitted.transform(rows).select("fold", "role", "pos", LABEL, F.col("prediction").cast("double").alias("prediction")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fold_scores(predictions: DataFrame, metrics: list[str], keys: list[str] = ()) -> DataFrame:
    """``keys, fold, <metric>, <metric>_train``: test and train scores side by side, from one pass over the predictions."""
    by_role = score(predictions, metrics, [*keys, "fold", "role"])
    pick = lambda m, role: F.max(F.when(F.col("role") == role, F.col(m)))
    return by_role.groupBy(*keys, "fold").agg(*[e for m in metrics for e in (pick(m, "test").alias(m), pick(m, "train").alias(m + "_train"))])


def summary_row(scores: DataFrame, metrics: list[str], data: str, folds: tuple[str, dict], model: tuple[str, dict],
                preproc: tuple[str, dict] | None = None) -> DataFrame:
    """One row per run: a list of fold scores per metric, and the names and parameters that produced them."""

    def params(p: dict):
        pairs = [F.lit(x) for k, v in p.items() for x in (k, json.dumps(v))]  # JSON keeps the types
        return F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")

    ordered = lambda m: F.transform(F.array_sort(F.collect_list(F.struct("fold", m))), lambda e: e[m]).alias(m)
    names = [m + s for m in metrics for s in ("", "_train")]
    nothing = F.lit(None).cast("string")
    return scores.agg(*[ordered(m) for m in names]).select(
        *names, F.lit(data).alias("data_fname"),
        (F.lit(preproc[0]) if preproc else nothing).alias("preproc_name"),
        (params(preproc[1]) if preproc else F.lit(None).cast("map<string,string>")).alias("preproc_params"),
        F.lit(folds[0]).alias("folds_name"), params(folds[1]).alias("folds_params"),
        F.lit(model[0]).alias("model_name"), params(model[1]).alias("model_params"))


def run_grid(tables: dict[str, DataFrame], columns: list[str], models: list[tuple[str, dict]], metrics: list[str],
             scaler: str | None = "StandardScaler", label: str = "ttf") -> DataFrame:
    """``folds_name, model_name, model_params, fold, <scores>`` for every fold table and model.

    All linear models of a fold table share two passes over its rows: one adds up moments, one predicts and scores.
    """
    names = [(model, json.dumps(params, sort_keys=True)) for model, params in models]
    linear = [i for i, (model, _) in enumerate(models) if model in moments.LINEAR]
    parts = []
    for name, folds in tables.items():
        if linear:
            lines = moments.fit_folds(folds.filter(F.col(label).isNotNull()), columns, [models[i] for i in linear], label, scaler)
            scores = fold_scores(moments.predicted(folds, lines, label), metrics, ["model"])
            told = lambda k: F.element_at(F.array(*[F.lit(names[i][k]) for i in linear]), F.col("model") + 1)  # noqa: E731, B023
            parts.append(scores.select(F.lit(name).alias("folds_name"), told(0).alias("model_name"), told(1).alias("model_params"), *scores.columns[1:]))
        others = [i for i in range(len(models)) if i not in linear]
        ready = prepared_folds(folds, columns, scaler, label) if others else None
        for i in others:
            scores = fold_scores(fold_predictions(ready, *models[i]), metrics)
            parts.append(scores.select(F.lit(name).alias("folds_name"), F.lit(names[i][0]).alias("model_name"), F.lit(names[i][1]).alias("model_params"), *scores.columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ridge_search(folds: DataFrame, columns: list[str], alphas: list[float], metrics: list[str], scaler: str | None = "StandardScaler", label: str = "ttf") -> DataFrame:
    """``alpha, <metric>_mean, <metric>_std``: test scores over the folds for each penalty, whatever their number in two passes."""
    lines = moments.fit_folds(folds.filter(F.col(label).isNotNull()), columns, [("Ridge", {"alpha": float(a)}) for a in alphas], label, scaler)
    scores = score(moments.predicted(folds.filter(F.col("role") == "test"), lines, label), metrics, ["model", "fold"])
    summary = [e for m in metrics for e in (F.avg(m).alias(m + "_mean"), F.stddev_pop(m).alias(m + "_std"))]
    alpha = F.element_at(F.array(*[F.lit(float(a)) for a in alphas]), F.col("model") + 1)
    return scores.groupBy(alpha.alias("alpha")).agg(*summary)


def random_search(space: dict[str, list], trials: int, objective, seed: int = 0) -> list[tuple[float, dict]]:
    """Score ``trials`` seeded draws from a parameter space; best first.  ``objective(params)`` returns a loss."""
    rng = random.Random(seed)
    drawn = [{k: rng.choice(v) for k, v in space.items()} for _ in range(trials)]
    return sorted(((objective(p), p) for p in drawn), key=lambda r: r[0])


def successive_halving(space: dict[str, list], trials: int, objective, budgets: list[int], seed: int = 0, keep: float = 1 / 3) -> list[tuple[float, int, dict]]:
    """Search with growing budgets: all draws get the first budget (a number of trees, say), the best ``keep`` of them the next.

    ``objective(params, budget)`` returns a loss.  Returns ``(loss, budget, params)`` of each draw's last turn: those that
    came furthest first, then by loss.  Equal draws are tried once.
    """
    if sorted(budgets) != list(budgets) or not budgets:
        raise ValueError("budgets must grow")
    rng = random.Random(seed)
    drawn = [{k: rng.choice(v) for k, v in space.items()} for _ in range(trials)]
    left = [p for i, p in enumerate(drawn) if p not in drawn[:i]]
    out: list[tuple[float, int, dict]] = []
    for i, budget in enumerate(budgets):
        scored = sorted(((objective(p, budget), p) for p in left), key=lambda r: r[0])
        go_on = max(1, int(len(scored) * keep)) if i + 1 < len(budgets) else 0
        out = [(loss, budget, p) for loss, p in scored[go_on:]] + out
        left = [p for _, p in scored[:go_on]]
    return sorted(out, key=lambda r: (-r[1], r[0]))


def summary_to_config(summary: DataFrame, rows: list[int] | int, order: list[str], path: str = "") -> dict:
    """A validation config from chosen summary rows (ordinals in the given order).

    Rows that name different data or preprocessors cannot share a config; repeated folds and models
    appear once.
    """
    wanted = [rows] if isinstance(rows, int) else list(rows)
    picked = summary.orderBy(*order).limit(max(wanted) + 1).collect()  # a handful of runs
    picked = [picked[i] for i in wanted]

    def once(items: list) -> list:
        return [x for i, x in enumerate(items) if x not in items[:i]]

    data = once([r["data_fname"] for r in picked])
    typed = lambda p: {k: json.loads(v) for k, v in (p or {}).items()}
    preproc = once([{"name": r["preproc_name"], **typed(r["preproc_params"])} for r in picked if r["preproc_name"] is not None])
    if len(data) > 1:
        raise ValueError("please use models with a single training table")
    if len(preproc) > 1:
        raise ValueError("please use models with a single preprocessor")
    config = {"summary_dest": path, "train_data": data[0], "metrics": [m for m in metric_columns(summary) if m != "run_at"],
              "folds": once([{"name": r["folds_name"], **typed(r["folds_params"])} for r in picked]),
              "validate": once([{"model": {r["model_name"]: typed(r["model_params"])}} for r in picked])}
    return {**config, "preproc": preproc[0]} if preproc else config


def write_config(spark: SparkSession, config: dict, path: str) -> None:
    """A config as a JSON file (one text row in a folder, like any table)."""
    spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_config(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def fit_pipeline(train: DataFrame, columns: list[str], model: str, params: dict, label: str = "ttf", scale: bool = True,
                 fill: str | None = None) -> PipelineModel:
    """Scaler and model as one unit to save and load.

    ``fill`` ("mean", "median" or "mode" of the training rows) replaces undefined features, in training and in scoring, so that
    no row is lost; without it an undefined feature is an error.

    Spark's scaler divides by the sample deviation; the factor after it makes that the population one.
    """
    df = train.filter(F.col(label).isNotNull()).withColumn(LABEL, F.col(label).cast("double"))
    stages: list[Transformer] = []
    inputs = columns
    if fill:
        inputs = ["_filled_" + c for c in columns]
        stages.append(Imputer(strategy=fill, inputCols=columns, outputCols=inputs).fit(df))
    stages.append(VectorAssembler(inputCols=inputs, outputCol="raw" if scale else FEATURES, handleInvalid="error"))
    if scale:
        n = df.count()
        stages.append(StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(PipelineModel(stages).transform(df)))
        factor = Vectors.dense([(n / (n - 1)) ** 0.5] * len(columns))
        stages.append(ElementwiseProduct(inputCol="scaled", outputCol=FEATURES, scalingVec=factor))
    ready = PipelineModel(stages).transform(df)
    return PipelineModel([*stages, create_model(model, params, ready).fit(ready)])


def score_segments(features: DataFrame, model: PipelineModel) -> DataFrame:
    """``seg_id, time_to_failure``: the prediction for the last window of every segment, all segments in one job."""
    predicted = model.transform(features)
    return predicted.groupBy(F.col(KEY).alias("seg_id")).agg(F.max_by("prediction", "win").alias("time_to_failure"))
