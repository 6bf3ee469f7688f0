"""Binning, histograms, quality checks, list columns, name handling and run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions import columns as C
from strideframe.functions.bins import clip, digitize, histogram, label_class
from strideframe.operators.quantiles import exact_quantiles
from strideframe.sources.tables import event_series, read_table

from . import query
from .rows import last
from .specs import LABELLED


@query("digitize", "SELECT event_id AS pos, least(greatest(floor(value / 50) + 1, 0), 8)::BIGINT AS y FROM events")
def digitized(spark, sf):
    return event_series(spark, sf).select("pos", digitize(F.col("x"), 0.0, 50.0, 8).alias("y"))


@query("digitize_fine", "SELECT event_id AS pos, least(greatest(floor(round(value * 100) / 10) + 1, 0), 1000)::BIGINT AS y FROM events")
def digitized_fine(spark, sf):
    # values carry two decimals; half a cent keeps them away from the inexact edges of a 0.1 grid
    return event_series(spark, sf).select("pos", digitize(F.col("x") + 0.005, 0.0, 0.1, 1000).alias("y"))


@query("label_class", f"WITH {LABELLED} SELECT pos, CASE WHEN ttf IS NULL THEN -1 ELSE least(floor(ttf / 100), 15)::BIGINT END AS y FROM lab")
def classes(spark, sf):
    return event_series(spark, sf, label=True).select("pos", F.coalesce(label_class(F.col("ttf") / 100), F.lit(-1)).alias("y"))


@query("clip", "SELECT event_id AS pos, least(greatest(value, 5.0), 90.0)::DOUBLE AS x FROM events")
def clipped(spark, sf):
    return event_series(spark, sf).select("pos", clip(F.col("x"), 5.0, 90.0).alias("x"))


@query("score_folder", "SELECT event_id AS pos, (least(floor(value / 100) + 1, 5) - 1)::BIGINT AS folder FROM events")
def score_folder(spark, sf):
    return event_series(spark, sf).select("pos", (digitize(F.col("x") / 100, 0.0, 1.0, 5) - 1).alias("folder"))


@query("histogram", """SELECT i AS bin, count(value) AS count FROM (SELECT unnest(range(60)) AS i) b
LEFT JOIN events ON CASE WHEN value = 600 THEN 59 ELSE floor(value / 10) END = i GROUP BY i""")
def counts(spark, sf):
    return histogram(event_series(spark, sf), "x", 0.0, 10.0, 60)


@query("exact_quantiles", """SELECT event_type, round(quantile_cont(value, 0.01), 6) AS q01, round(quantile_cont(value, 0.5), 6) AS q50,
round(quantile_cont(value, 0.99), 6) AS q99, min(value) AS q0, max(value) AS q1 FROM events GROUP BY event_type""")
def quantiles(spark, sf):
    out = exact_quantiles(read_table(spark, sf, "events"), ["event_type"], "value", {"q01": .01, "q50": .5, "q99": .99, "q0": 0.0, "q1": 1.0}, accuracy=200)
    return out.select("event_type", *[F.round(q, 6).alias(q) for q in ("q01", "q50", "q99")], "q0", "q1")


@query("any_missing", f"WITH {LABELLED} SELECT bool_or(isnan(x)) AS x_nan, bool_or(ttf IS NULL) AS ttf_null, min(x) AS low FROM lab")
def missing(spark, sf):
    return event_series(spark, sf, label=True).agg(F.bool_or(F.isnan("x")).alias("x_nan"), F.bool_or(F.col("ttf").isNull()).alias("ttf_null"),
                                                   F.min("x").alias("low"))


@query("ramp", """SELECT event_id AS pos, round(event_id / ((SELECT max(event_id) FROM events)::DOUBLE), 9) AS up,
round(1 - event_id / ((SELECT max(event_id) FROM events)::DOUBLE), 9) AS down FROM events""")
def ramps(spark, sf):
    s = event_series(spark, sf)
    n = s.agg((F.max("pos") + 1).alias("n")).scalar()
    return s.withColumn("n", n).select("pos", F.round(C.ramp(F.col("pos"), F.col("n")), 9).alias("up"),
                                       F.round(C.ramp(F.col("pos"), F.col("n"), inverted=True), 9).alias("down"))


@query("trend_overlay", """WITH b AS (SELECT avg(value + 0.002 * event_id) AS b FROM events)
SELECT event_id AS pos, round(greatest(-0.002 * event_id + b, 0), 6) AS trend FROM events, b""")
def trend(spark, sf):
    return C.trend_overlay(event_series(spark, sf), "pos", "x", -0.002).select("pos", F.round("trend", 6).alias("trend"))


@query("metric_columns", "SELECT label AS quality FROM embeddings")
def metrics(spark, sf):
    df = read_table(spark, sf, "embeddings").withColumnsRenamed({"label": "quality", "vec_id": "model_id", "embedding": "data_vector"})
    return df.select(*C.metric_columns(df))


@query("columns_by_mask", "SELECT event_id, value FROM events")
def masked(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "ts", "value", "props")
    return ev.select(*C.by_mask(ev.columns, [False, True, False, True], invert=True))


@query("names", """SELECT event_id, split_part(event_type || '_' || user_id || '.csv', '.', 1) AS segment,
CASE WHEN props = '' THEN props ELSE props[:5] || '..' END AS short, regexp_replace(event_type, 'e', 'E', 'g') AS renamed,
ends_with(event_type, 'w') AS w FROM events""")
def names(spark, sf):
    ev = read_table(spark, sf, "events")
    return ev.select("event_id", C.segment_id(F.concat("event_type", F.lit("_"), "user_id", F.lit(".csv"))).alias("segment"),
                     C.truncate_name(F.col("props"), 5).alias("short"), F.regexp_replace("event_type", "e", "E").alias("renamed"),
                     F.endswith("event_type", F.lit("w")).alias("w"))


@query("join_details", """SELECT event_id, CASE WHEN value > 100 THEN event_type || chr(10) ELSE '' END || user_id || chr(10) AS label FROM events""")
def details(spark, sf):
    ev = read_table(spark, sf, "events")
    return ev.select("event_id", C.join_details(F.when(F.col("value") > 100, F.col("event_type")), F.col("user_id").cast("string")).alias("label"))


@query("timestamp_label", "SELECT event_id, strftime(ts, 'date%d_%m_time%H_%M_%S') AS label FROM events")
def stamps(spark, sf):
    return read_table(spark, sf, "events").select("event_id", C.timestamp_label(F.col("ts")).alias("label"))


# score lists: the values of a user's events, of one type or all


@query("parse_list", "SELECT event_id, round((value + user_id + 1) / 3, 8) AS mean FROM events")
def parsed(spark, sf):
    """A short list read back from its text."""
    text = F.to_json(F.array(F.col("value"), F.col("user_id").cast("double"), F.lit(1.0)))
    df = read_table(spark, sf, "events").select("event_id", C.parse_list(text).alias("v"))
    return df.select("event_id", F.round(C.array_mean(F.col("v")), 8).alias("mean"))


@query("list_statistics_of_rows", """WITH m AS (SELECT [value, coalesce(user_id, 0), 0] AS v, event_id FROM events)
SELECT event_id, round(list_avg(v), 8) AS v_mean, list_min(v) AS v_min, list_max(v) AS v_max, round(list_stddev_samp(v), 6) AS v_std FROM m""")
def list_stats_of_rows(spark, sf):
    """Short lists in rows, as in a run summary; one in two lacks the last entry."""
    lists = F.when(F.col("event_id") % 2 == 0, F.array("value", F.col("user_id").cast("double"))).otherwise(F.array("value", F.col("user_id").cast("double"), F.lit(0.0)))
    out = C.list_statistics(read_table(spark, sf, "events").select("event_id", lists.alias("v")), "v")
    return out.select("event_id", F.round("v_mean", 8).alias("v_mean"), "v_min", "v_max", F.round("v_std", 6).alias("v_std"))


@query("list_statistics", """WITH l AS (SELECT user_id, event_type, list(value ORDER BY event_id) AS v FROM events GROUP BY 1, 2),
m AS (SELECT max(len(v)) AS m FROM l), c AS (SELECT user_id, event_type, unnest(range(1, m + 1)) AS i, v FROM l, m),
d AS (SELECT user_id, event_type, coalesce(v[i], 0) AS x FROM c)
SELECT user_id, event_type, round(avg(x), 8) AS v_mean, min(x) AS v_min, max(x) AS v_max, round(stddev_samp(x), 6) AS v_std FROM d GROUP BY 1, 2""")
def list_stats(spark, sf):
    out = C.score_statistics(read_table(spark, sf, "events").withColumnRenamed("value", "v"), ["user_id", "event_type"], "v")
    return out.select("user_id", "event_type", F.round("v_mean", 8).alias("v_mean"), "v_min", "v_max", F.round("v_std", 6).alias("v_std"))


@query("best_runs", """WITH l AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY 1),
m AS (SELECT max(len(v)) AS m FROM l), c AS (SELECT user_id, unnest(range(1, m + 1)) AS i, v FROM l, m)
SELECT user_id, round(avg(coalesce(v[i], 0)), 8) AS v_mean FROM c GROUP BY user_id ORDER BY v_mean""")
def best_runs(spark, sf):
    out = C.score_statistics(read_table(spark, sf, "events").withColumnRenamed("value", "v"), ["user_id"], "v").orderBy("v_mean")
    return out.select("user_id", F.round("v_mean", 8).alias("v_mean"))


@query("best_summary_runs", """SELECT event_type, round((sum(value) FILTER (user_id = 1) + coalesce(sum(value) FILTER (user_id = 2), 0)) / 2, 6) AS v_mean
FROM events WHERE user_id IN (1, 2) GROUP BY event_type ORDER BY v_mean""")
def best_summary(spark, sf):
    """Run summaries with short score lists, best first."""
    sums = read_table(spark, sf, "events").filter("user_id in (1, 2)").groupBy("event_type").agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("user_id") == u, F.col("value"))), F.lit(0.0)) for u in (1, 2)]).alias("v"))
    return C.best_runs(sums, "v").select("event_type", F.round("v_mean", 6).alias("v_mean"))


@query("transpose_scores", "SELECT row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position, user_id, value FROM events")
def transposed_rows(spark, sf):
    """The transposed lists in rows, for lists of any length."""
    df = read_table(spark, sf, "events").select("user_id", "event_id", "value")
    return C.transpose_scores(df, ["user_id"], "event_id").select("position", "user_id", "value")


@query("transpose_lists", """WITH l AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY 1),
m AS (SELECT max(len(v)) AS m FROM l), c AS (SELECT user_id, unnest(range(1, m + 1)) AS i, v FROM l, m)
SELECT (i - 1)::INTEGER AS position, array_to_string(list(CAST(coalesce(v[i], 0) AS DECIMAL(18, 2)) ORDER BY user_id), ',') AS vals FROM c GROUP BY i""")
def transposed(spark, sf):
    ev = read_table(spark, sf, "events")
    by_order = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda e: e["value"])
    df = ev.groupBy("user_id").agg(by_order.alias("v"))
    text = F.array_join(F.transform("values", lambda v: v.cast("decimal(18,2)").cast("string")), ",")
    return C.transpose_lists(df, "v", "user_id").select("position", text.alias("vals"))


@query("parse_map", """SELECT event_id, props->>'k' AS k FROM events""")
def maps(spark, sf):
    return read_table(spark, sf, "events").select("event_id", C.parse_map(F.col("props"))["k"].alias("k"))


@query("moving_columns_side_by_side", f"""SELECT event_id AS pos, round(avg(value) OVER {last(5)}, 6) AS m5, round(avg(value) OVER {last(25)}, 6) AS m25 FROM events""")
def side_by_side(spark, sf):
    from strideframe.operators.rolling import rolled
    from strideframe.operators.windows import assemble
    s = event_series(spark, sf)
    parts = [rolled(s, [("r_mean", {"window_size": w})]).select("series_id", "pos", F.round("x", 6).alias(f"m{w}")) for w in (5, 25)]
    return assemble(parts, ["series_id", "pos"]).drop("series_id")
