"""Row-preserving operators over the whole event signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators.rolling import rolled
from strideframe.sources.tables import event_series, user_series

from . import query

USERS = """u AS (SELECT CAST(user_id AS VARCHAR) AS series_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos, value AS x FROM events)"""


def rows_query(name: str, ops: list, sql: str, digits: int = 6):
    select = f"SELECT event_id AS pos, round({sql}, {digits}) AS x FROM events"
    query(name, sql if sql.lstrip().upper().startswith(("SELECT", "WITH")) else select)(
        lambda spark, sf: rolled(event_series(spark, sf), ops).select("pos", F.round("x", digits).alias("x")))


def last(w: int) -> str:
    return f"(ORDER BY event_id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


rows_query("r_std", [("r_std", {"window_size": 100})], f"stddev_pop(value) OVER {last(100)}")
rows_query("r_mean", [("r_mean", {"window_size": 100})], f"avg(value) OVER {last(100)}")
rows_query("r_sta_lta", [("r_sta_lta", {"sta_window": 20, "lta_window": 200})], f"""
  CASE WHEN event_id < 199 THEN 0 ELSE sum(value * value) OVER {last(20)} / 20 END
  / greatest(sum(value * value) OVER {last(200)} / 200, 2.2250738585072014e-308)""")
rows_query("r_clip", [("r_clip", {"q_low": 0.05, "q_high": 0.95})], """
  least(greatest(value, (SELECT quantile_cont(value, 0.05) FROM events)), (SELECT quantile_cont(value, 0.95) FROM events))""")

H = 50
rows_query("r_savgol_filter", [("r_savgol_filter", {"window_length": 2 * H + 1, "polyorder": 1})], f"""
WITH m AS (SELECT max(event_id) + 1 AS n FROM events),
e AS (SELECT event_id AS pos, value AS x, n FROM events, m),
head AS (SELECT avg(x) AS a, sum(x * (pos - {H})) / sum((pos - {H}) * (pos - {H})) AS b FROM e WHERE pos <= {2 * H}),
tail AS (SELECT avg(x) AS a, sum(x * (pos - (n - 1 - {H}))) / sum((pos - (n - 1 - {H})) * (pos - (n - 1 - {H}))) AS b
         FROM e WHERE pos >= n - {2 * H + 1}),
f AS (SELECT pos, n, avg(x) OVER (ORDER BY pos ROWS BETWEEN {H} PRECEDING AND {H} FOLLOWING) AS y FROM e)
SELECT pos, round(CASE WHEN pos < {H} THEN head.a + head.b * (pos - {H})
                       WHEN pos > n - 1 - {H} THEN tail.a + tail.b * (pos - (n - 1 - {H})) ELSE y END, 6) AS x
FROM f, head, tail""")

rows_query("r_savgol_filter_order2", [("r_savgol_filter", {"window_length": 11, "polyorder": 2})], """
WITH k AS (SELECT unnest(range(-5, 6)) AS k),
c AS (SELECT k, (1958.0 - 110 * k * k) / (11 * 1958 - 110 * 110)::DOUBLE AS w FROM k),
m AS (SELECT max(event_id) AS top FROM events),
mid AS (SELECT e.event_id + c.k AS pos, sum(e.value * c.w) AS y
        FROM events e, c GROUP BY 1),
inner_rows AS (SELECT pos, y FROM mid, m WHERE pos BETWEEN 5 AND top - 5),
ends AS (SELECT side, event_id - CASE side WHEN 0 THEN 5 ELSE top - 5 END AS j, value AS x, top
         FROM events, m, (SELECT unnest([0, 1]) AS side)
         WHERE (side = 0 AND event_id <= 10) OR (side = 1 AND event_id >= top - 10)),
fit AS (SELECT side, any_value(top) AS top, sum(x * (1958 - 110 * j * j)) / 9438 AS a, sum(x * j) / 110 AS b,
        sum(x * (11 * j * j - 110)) / 9438 AS c FROM ends GROUP BY side)
SELECT pos, round(y, 6) AS x FROM inner_rows
UNION ALL
SELECT CASE side WHEN 0 THEN 5 + j ELSE top - 5 + j END AS pos, round(a + b * j + c * j * j, 6) AS x
FROM fit, (SELECT unnest(range(-5, 6)) AS j) o WHERE (side = 0 AND j < 0) OR (side = 1 AND j > 0)""")

rows_query("r_std_then_mean", [("r_std", {"window_size": 50}), ("r_mean", {"window_size": 20})], f"""
WITH s AS (SELECT event_id, stddev_pop(value) OVER {last(50)} AS y FROM events)
SELECT event_id AS pos, round(avg(y) OVER {last(20)}, 6) AS x FROM s""")


@query("r_mean_per_series", f"""WITH {USERS}
SELECT series_id, pos, round(avg(x) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS x FROM u""")
def r_mean_per_series(spark, sf):
    return rolled(user_series(spark, sf), [("r_mean", {"window_size": 10})]).select("series_id", "pos", F.round("x", 6).alias("x"))
