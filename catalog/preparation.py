"""Series preparation: slices, cycles, decimation, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions.slices import leading_share, row_range, three_slices
from strideframe.operators.cycles import combine_cycles, cycle_boundaries, split_cycles
from strideframe.operators.matching import (analogue_labels, analogues, best_match, cross_correlation, template_information)
from strideframe.operators.windows import window_features
from strideframe.series import contract_violations, lengths
from strideframe.sources.readers import read_by_extension, read_cycles
from strideframe.sources.tables import event_series, read_table, user_series
from strideframe.tables import new_path
from strideframe.sources.writers import memoized, write_cycles, write_features

from . import query
from .rows import USERS
from .specs import LABELLED
from .windows import S, W, windows_cte

# a cycle of the test signal ends where labels stay above LOW for more than GAP rows
LOW, GAP = 60.0, 15
BOUNDS = f"""{LABELLED},
low AS (SELECT pos, lead(pos) OVER (ORDER BY pos) AS nxt FROM lab WHERE ttf < {LOW}),
b AS (SELECT 0 AS boundary UNION ALL SELECT pos FROM low WHERE nxt IS NULL OR nxt - pos > {GAP}),
c AS (SELECT row_number() OVER (ORDER BY boundary) AS cycle_id, boundary AS start, lead(boundary) OVER (ORDER BY boundary) AS stop FROM b),
cyc AS (SELECT lab.*, cycle_id, start FROM lab JOIN c ON pos >= start AND pos < stop)"""


def scratch(spark, name: str) -> str:
    """A new path in the cluster's shared folder."""
    return new_path(spark, name)


@query("label_time_to_next", f"WITH {LABELLED} SELECT pos, round(ttf, 6) AS ttf FROM lab")
def label_time_to_next(spark, sf):
    return event_series(spark, sf, label=True).select("pos", F.round("ttf", 6).alias("ttf"))


@query("series_lengths", f"WITH {USERS} SELECT series_id, count(*) AS n FROM u GROUP BY series_id")
def series_lengths(spark, sf):
    return lengths(user_series(spark, sf))


@query("contract_violations", f"""WITH {USERS}, b AS (SELECT * FROM u WHERE NOT (CAST(series_id AS BIGINT) % 7 = 0 AND pos = 3)
UNION ALL SELECT * FROM u WHERE CAST(series_id AS BIGINT) % 11 = 0 AND pos = 0)
SELECT series_id, count(*) AS rows, min(pos) AS first_pos, max(pos) AS last_pos FROM b GROUP BY 1
HAVING CAST(series_id AS BIGINT) % 7 = 0 AND max(pos) > 3 OR CAST(series_id AS BIGINT) % 11 = 0""")
def violations(spark, sf):
    """Some users lack a position, some have one twice, some both."""
    s = user_series(spark, sf)
    number = F.col("series_id").cast("bigint")
    broken = s.filter(~((number % 7 == 0) & (F.col("pos") == 3))).union(s.filter((number % 11 == 0) & (F.col("pos") == 0)))
    return contract_violations(broken)


@query("cycle_boundaries", f"WITH {BOUNDS} SELECT boundary::BIGINT AS boundary FROM b")
def boundaries(spark, sf):
    return cycle_boundaries(event_series(spark, sf, label=True), LOW, GAP).select("boundary")


@query("split_cycles", f"WITH {BOUNDS} SELECT pos, cycle_id::INTEGER AS cycle_id, x, round(ttf, 6) AS ttf FROM cyc")
def split(spark, sf):
    return split_cycles(event_series(spark, sf, label=True), LOW, GAP).select("pos", "cycle_id", "x", F.round("ttf", 6).alias("ttf"))


COMBINED = f"""WITH {BOUNDS} SELECT (row_number() OVER (ORDER BY pos) - 1) AS pos, cycle_id::INTEGER AS cycle_id, x
FROM cyc WHERE cycle_id NOT IN (2, 3, 8, 16)"""


@query("combine_cycles", COMBINED)
def combine(spark, sf):
    cycles = split_cycles(event_series(spark, sf, label=True), LOW, GAP)
    return combine_cycles(cycles, [2, 3, 8, 16]).select("pos", "cycle_id", "x")


@query("write_and_read_cycles", f"WITH {BOUNDS} SELECT cycle_id::INTEGER AS cycle_id, count(*) AS n, round(sum(x), 4) AS total FROM cyc WHERE cycle_id IN (1, 4, 5) GROUP BY 1")
def stored_cycles(spark, sf):
    path = scratch(spark, "cycles")
    write_cycles(split_cycles(event_series(spark, sf, label=True), LOW, GAP), path)
    return (read_cycles(spark, path, only=[1, 4, 5]).groupBy("cycle_id")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("total")))


@query("write_and_read_features", f"WITH {windows_cte()} SELECT win, round(avg(x), 6) AS avg_x FROM r GROUP BY win")
def stored_features(spark, sf):
    path = scratch(spark, "features.parquet")
    write_features(window_features(event_series(spark, sf), {"avg_x": ("w_mean", {})}, W, S), path)
    return read_by_extension(spark, path).select("win", F.round("avg_x", 6).alias("avg_x"))


@query("memoized_features", f"WITH {windows_cte()} SELECT win, max(x) AS top FROM r GROUP BY win")
def memo(spark, sf):
    directory = scratch(spark, "memo")
    build = lambda: window_features(event_series(spark, sf), {"top": ("w_max", {})}, W, S)
    memoized(spark, directory, "k", build)
    return memoized(spark, directory, "k", lambda: None).select("win", "top")


@query("decimate", f"""WITH {LABELLED}, {windows_cte()} SELECT win, lab.x, round(lab.ttf, 6) AS ttf FROM k
JOIN lab ON pos = least(win * {S} + {W}, total) - 1""")
def decimate(spark, sf):
    df = window_features(event_series(spark, sf, label=True), {"x": ("w_last_elem", {})}, W, S, label=True)
    return df.select("win", "x", F.round("ttf", 6).alias("ttf"))


@query("row_range", "SELECT event_id AS pos, value AS x FROM events WHERE event_id >= 100 AND event_id < 400")
def rows(spark, sf):
    return row_range(event_series(spark, sf), 100, 400).select("pos", "x")


@query("leading_tenth", f"""WITH {USERS}, n AS (SELECT series_id, count(*) AS n FROM u GROUP BY 1)
SELECT series_id, pos, x FROM u JOIN n USING (series_id) WHERE pos < n // 10""")
def tenth(spark, sf):
    return leading_share(user_series(spark, sf)).select("series_id", "pos", "x")


@query("three_slices", """WITH m AS (SELECT max(event_id) + 1 AS n FROM events),
p AS (SELECT 'first' AS part, 0 AS a, 150 AS b, n FROM m UNION ALL SELECT 'middle', (n - 150) // 2, (n + 150) // 2, n FROM m
UNION ALL SELECT 'last', n - 150, n, n FROM m)
SELECT part, event_id AS pos, value AS x FROM p JOIN events ON event_id >= a AND event_id < b""")
def slices(spark, sf):
    return three_slices(event_series(spark, sf), 150).select("part", "pos", "x")


# analogues of the last window's median among all windows
MEDIANS = f"""{LABELLED}, {windows_cte(source="SELECT pos, avg(x) OVER (ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS x FROM lab")},
f AS (SELECT win, median(x) AS med FROM r GROUP BY win),
t AS (SELECT f.win, med, ttf FROM f JOIN k USING (win) JOIN lab ON pos = least(win * {S} + {W}, total) - 1),
probe AS (SELECT arg_max(med, win) AS p FROM t),
g AS (SELECT i AS eps_id, CASE WHEN i = 99 THEN 0.6::DOUBLE ELSE i * (CAST(1.4 AS DOUBLE) / 99) + CAST(-0.8 AS DOUBLE) END AS eps FROM (SELECT unnest(range(100)) AS i)),
hit AS (SELECT eps_id, eps, win, ttf FROM t, probe, g WHERE abs(p + eps - med) <= CAST(0.02 AS DOUBLE) + CAST(0.00001 AS DOUBLE) * abs(med))"""


def medians(spark, sf):
    df = window_features(event_series(spark, sf, label=True), {"med": ("w_median", {})}, W, S, rows=[("r_mean", {"window_size": 10})], label=True)
    return df, df.agg(F.max_by("med", "win").alias("p")).scalar()


@query("analogue_labels", f"WITH {MEDIANS} SELECT eps_id, round(any_value(eps), 6) AS eps, round(avg(ttf), 3) AS label, count(*) AS matches FROM hit GROUP BY eps_id")
def analogue(spark, sf):
    df, probe = medians(spark, sf)
    out = analogue_labels(df, "med", "ttf", probe, atol=0.02)
    return out.select("eps_id", F.round("eps", 6).alias("eps"), F.round("label", 3).alias("label"), "matches")


@query("analogue_histogram", f"""WITH {MEDIANS}, b AS (SELECT unnest(range(CAST(floor(max(ttf) / 100) AS BIGINT) + 1)) AS bin FROM t)
SELECT bin, count(ttf) AS count FROM b LEFT JOIN hit ON floor(ttf / 100) = bin GROUP BY bin""")
def analogue_histogram(spark, sf):
    from strideframe.functions.bins import histogram
    df, probe = medians(spark, sf)
    bins = int(df.agg(F.max("ttf")).first()[0] // 100) + 1  # as many as the labels need
    return histogram(analogues(df, "med", probe, atol=0.02), "ttf", 0.0, 100.0, bins)


M = 40
CORR = f"""WITH t AS (SELECT event_id - 100 AS j, value AS t FROM events WHERE event_id >= 100 AND event_id < {100 + M}),
m AS (SELECT max(event_id) + 1 AS n FROM events),
c AS (SELECT event_id - j AS pos, sum(value * t) AS corr FROM events, t GROUP BY 1)
SELECT {{}} FROM c, m WHERE pos >= 0 AND pos <= n - {M}"""


def template(spark, sf):
    return row_range(event_series(spark, sf), 100, 100 + M).withColumn("pos", F.col("pos") - 100)


@query("cross_correlation", CORR.format("pos, round(corr, 4) AS corr"))
def correlation(spark, sf):
    return cross_correlation(event_series(spark, sf), template(spark, sf)).select("pos", F.round("corr", 4).alias("corr"))


@query("best_match", CORR.format("arg_max(pos, corr) AS pos, round(max(corr), 4) AS corr"))
def match(spark, sf):
    return best_match(cross_correlation(event_series(spark, sf), template(spark, sf))).select("pos", F.round("corr", 4).alias("corr"))


NMI_SCAN = """WITH m AS (SELECT max(event_id) + 1 AS n FROM events), k AS (SELECT unnest(range(0, n - 200, 100)) AS start FROM m),
t AS (SELECT event_id - 300 AS j, least(greatest(floor(value / 10) + 1, 0), 60) AS b FROM events WHERE event_id >= 300 AND event_id < 500),
p AS (SELECT start // 100 AS win, least(greatest(floor(value / 10) + 1, 0), 60) AS a, b FROM k
      JOIN events ON event_id >= start AND event_id < start + 200 JOIN t ON j = event_id - start),
j AS (SELECT win, a, b, count(*)::DOUBLE AS c FROM p GROUP BY 1, 2, 3),
h AS (SELECT win, sum(c) AS n, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM j GROUP BY 1),
ha AS (SELECT win, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM (SELECT win, a, sum(c) AS c FROM j GROUP BY 1, 2) GROUP BY 1),
hb AS (SELECT win, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM (SELECT win, b, sum(c) AS c FROM j GROUP BY 1, 2) GROUP BY 1)
SELECT win, round((ha.h + hb.h - h.h) / ((ha.h + hb.h) / 2), 6) AS nmi FROM h JOIN ha USING (win) JOIN hb USING (win)"""


@query("template_information", NMI_SCAN)
def information_scan(spark, sf):
    s = event_series(spark, sf)
    shape = row_range(s, 300, 500).withColumn("pos", F.col("pos") - 300)
    return template_information(s, shape, 200, 100, 0.0, 600.0, 10.0).select("win", F.round("nmi", 6).alias("nmi"))


EVERY_SHIFT = (NMI_SCAN.replace("range(0, n - 200, 100)", "range(0, n - 200)").replace("start // 100", "start")
               .replace("floor(value / 10) + 1, 0), 60)", "floor(value / 50) + 1, 0), 12)"))


@query("template_information_every_shift", EVERY_SHIFT)
def information_of_every_shift(spark, sf):
    s = event_series(spark, sf)
    shape = row_range(s, 300, 500).withColumn("pos", F.col("pos") - 300)
    return template_information(s, shape, 200, 1, 0.0, 600.0, 50.0).select("win", F.round("nmi", 6).alias("nmi"))


@query("array_mean", "SELECT vec_id, round(list_avg(embedding), 6) AS m FROM embeddings")
def array_means(spark, sf):
    from strideframe.functions.columns import array_mean
    return read_table(spark, sf, "embeddings").select("vec_id", F.round(array_mean(F.transform("embedding", lambda v: v.cast("double"))), 6).alias("m"))
