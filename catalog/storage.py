"""Sources and sinks, written to and read back from the shared folder."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from strideframe.models import folds as FO
from strideframe.models import runs
from strideframe.sources.readers import find_files, read_by_extension, read_segments, read_training_csv
from strideframe.sources.tables import read_table
from strideframe.sources.writers import append_predictions, append_summary, convert_signal, latest_predictions, read_predictions, read_summary, write_segments
from strideframe.tables import new_path

from . import query
from .validation import KT, PARAMS, ROLES, count_events, event_rows, folded

SIGNAL = "SELECT event_id AS pos, floor(value)::DOUBLE AS x, (event_id % 1000 / 8.0)::DOUBLE AS ttf FROM events"


def training_csv(spark, sf) -> str:
    """The events in the layout of the published training file: one CSV file in row order."""
    path = new_path(spark, "train.csv")
    ev = read_table(spark, sf, "events").orderBy("event_id")
    ev = ev.select(F.floor("value").cast("int").alias("acoustic_data"), (F.col("event_id") % 1000 / 8.0).alias("time_to_failure"))
    ev.coalesce(1).write.csv(path, header=True)
    return path


@query("read_training_csv", SIGNAL)
def typed_csv(spark, sf):
    return read_training_csv(spark, training_csv(spark, sf)).select("pos", "x", "ttf")


@query("convert_signal", f"WITH s AS ({SIGNAL}) SELECT x AS s, ttf, count(*) AS n FROM s GROUP BY 1, 2")
def converted(spark, sf):
    target = new_path(spark, "train.parquet")
    convert_signal(spark, training_csv(spark, sf), target)
    df = read_by_extension(spark, target)
    return df.groupBy(F.col("s").cast("double").alias("s"), F.col("ttf").cast("double").alias("ttf")).agg(F.count(F.lit(1)).alias("n"))


@query("read_with_fallback", "SELECT event_id, value FROM events")
def with_fallback(spark, sf):
    path = new_path(spark, "events.hdf")
    read_table(spark, sf, "events").select("event_id", "value").write.parquet(path)
    return read_by_extension(spark, path, fallback="parquet")


def segment_files(spark, sf) -> str:
    """One CSV file per user, in time order."""
    path = new_path(spark, "segments")
    ev = read_table(spark, sf, "events").select("user_id", "ts", F.col("value").alias("acoustic_data"))
    write_segments(ev, path, "user_id", "ts", "acoustic_data")
    return path


@query("read_segments", """SELECT CAST(user_id AS VARCHAR) AS series_id, count(*) AS n, arg_min(value, ts) AS head, arg_max(value, ts) AS tail, round(sum(value), 4) AS total
FROM events GROUP BY user_id""")
def segments(spark, sf):
    s = read_segments(spark, segment_files(spark, sf), recursive=True, folder_key="user_id")
    return s.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("x", "pos").alias("head"), F.max_by("x", "pos").alias("tail"),
                                      F.round(F.sum("x"), 4).alias("total"))


@query("find_files", "SELECT count(DISTINCT user_id) AS files FROM events")
def files(spark, sf):
    return find_files(spark, segment_files(spark, sf), "*.csv").agg(F.count(F.lit(1)).alias("files"))


@query("append_predictions", f"""WITH {KT} SELECT pos, round(arg_max(ttf, fold), 6) AS y, round(arg_max(prediction, fold), 3) AS yhat
FROM pr WHERE role = 'test' GROUP BY pos""")
def predictions(spark, sf):
    path = new_path(spark, "out-of-fold")
    out = runs.out_of_fold(folded(spark, sf), ["avg_x"], "LinearRegression", {}).filter("role = 'test'")
    append_predictions(out, path, "first")
    append_predictions(out.withColumn("prediction", F.lit(0.0)), path, "second")
    back = latest_predictions(read_predictions(spark, path, "first"))
    return back.select("pos", F.round("y", 6).alias("y"), F.round("yhat", 3).alias("yhat"))


@query("append_summary", f"""WITH {KT}, s AS (SELECT fold, avg(abs(ttf - prediction)) AS mae, avg((ttf - prediction) ** 2) AS mse FROM pr WHERE role = 'test' GROUP BY fold),
a AS (SELECT list(round(mae, 4) ORDER BY fold) AS mae, list(round(mse, 2) ORDER BY fold) AS mse FROM s)
SELECT 'one' AS data_fname, array_to_string(mae, ' ') AS mae, NULL::VARCHAR AS mse FROM a UNION ALL SELECT 'two', array_to_string(mae, ' '), array_to_string(mse, ' ') FROM a""")
def appended(spark, sf):
    """Two runs with different metrics in one table."""
    path = new_path(spark, "summary")
    out = runs.out_of_fold(folded(spark, sf), ["avg_x"], "LinearRegression", {})
    for name, metrics in (("one", ["mean_absolute_error"]), ("two", ["mean_absolute_error", "mean_squared_error"])):
        append_summary(runs.summary_row(runs.fold_scores(out, metrics), metrics, name, ("KFold", {"n_splits": 3}), ("LinearRegression", {})), path)
    text = lambda c, d: F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, lambda v: F.round(v, d).cast("string")), " "))
    return read_summary(spark, path).select("data_fname", text("mean_absolute_error", 4).alias("mae"), text("mean_squared_error", 2).alias("mse"))


@query("config_round_trip", f"WITH {ROLES} SELECT fold::INTEGER AS fold, role, count(*) AS n FROM roles GROUP BY 1, 2")
def config_folds(spark, sf):
    """Folds drawn from a config that went through a summary and a JSON file."""
    out = runs.fold_scores(runs.out_of_fold(folded(spark, sf), ["avg_x"], "LinearRegression", {}), ["mean_absolute_error"])
    row = runs.summary_row(out, ["mean_absolute_error"], "events", ("CustomFold", PARAMS), ("LinearRegression", {}), ("StandardScaler", {}))
    path = new_path(spark, "config.json")
    runs.write_config(spark, runs.summary_to_config(row, 0, ["model_name"], path), path)
    config = runs.read_config(spark, path)
    assert json.loads(json.dumps(config)) == config
    name, params = config["folds"][0].pop("name"), config["folds"][0]
    return FO.SPLITS[name](event_rows(spark, sf), count_events(spark, sf), **params).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))
