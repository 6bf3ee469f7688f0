"""Mutual information of two continuous columns from distances to the kth nearest neighbour.

Around each row lies the square that reaches to its kth nearest neighbour (the larger of the two differences counts).  The rows
that are closer than that in one column alone, and in the other alone, tell how far the columns are from being independent.

Both columns are first brought to steps of 2^-32 of their standard deviation, whole numbers, so that a tie is a tie and "closer
than" is exact.  Rows that agree in both columns become one point with a weight, so that no value can make a cell large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..frame import idiv
from ..series import dense_positions, join_small
from ..tables import written

STEPS = float(1 << 32)
FAR = 1 << 62
CHUNK = 256
POINT = ["key", "a", "b"]
LOW, VALUE, HIGH, TOTAL = range(4)  # at equal values, in this order


def digamma(m: Column) -> Column:
    """Digamma of a positive number: asymptotic series six places further up, and the recurrence back (error below 1e-10)."""
    m = m.cast("double")
    z = m + 6
    back = sum((1 / (m + j) for j in range(1, 6)), 1 / m)
    return (F.log(z) - 1 / (2 * z) - 1 / (12 * z ** 2) + 1 / (120 * z ** 4) - 1 / (252 * z ** 6) + 1 / (240 * z ** 8)) - back


def _points(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``key, a, b, w, n``: distinct points in steps, with how many rows are there and how many rows the key has."""
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    rows = df.select(F.col(key).alias("key"), finite(F.col(a).cast("double")).alias("a"), finite(F.col(b).cast("double")).alias("b"))
    rows = rows.filter("key is not null and a is not null and b is not null")
    spread = lambda c: F.when(F.min(c) == F.max(c), 1.0).otherwise(F.stddev_pop(c)).alias("s" + c)
    moments = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[e for c in "ab" for e in (F.avg(c).alias("m" + c), spread(c))])
    steps = [F.floor((F.col(c) - F.col("m" + c)) / F.col("s" + c) * STEPS + 0.5).alias(c) for c in "ab"]
    return join_small(rows, moments, ["key"]).groupBy("key", "n", *steps).agg(F.count(F.lit(1)).alias("w"))


def _cells(points: DataFrame, cell: int) -> DataFrame:
    """Deal the points to cells of ``cell`` points: strips of equal size along ``a``, each cut along ``b``."""
    points = written(points, "points")
    width = points.groupBy("key").agg(F.ceil(F.sqrt(F.count(F.lit(1)) * F.lit(float(cell)))).alias("width"))
    rows = dense_positions(points.withColumn("_order", F.struct("a", "b")), ["key"], "_order")
    rows = join_small(rows, width, ["key"]).withColumn("strip", F.expr("pos div width")).drop("pos", "width")
    rows = dense_positions(rows.withColumn("_order", F.struct("b", "a")), ["key", "strip"], "_order")
    return rows.select(*POINT, "w", "n", "strip", idiv("pos", cell).alias("cell"))


def nearest(qa: np.ndarray, qb: np.ndarray, pa: np.ndarray, pb: np.ndarray, pw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances from each query to its k + 1 nearest points (all, if fewer), in no order, and the weights of those points."""
    take = min(k + 1, len(pa))
    dist = np.empty((len(qa), take), np.int64)
    many = np.empty((len(qa), take), np.int64)
    for at in range(0, len(qa), CHUNK):
        part = slice(at, at + CHUNK)
        d = np.maximum(np.abs(pa - qa[part, None]), np.abs(pb - qb[part, None]))
        best = np.argpartition(d, take - 1, axis=1)[:, :take]
        dist[part], many[part] = np.take_along_axis(d, best, 1), pw[best]
    return dist, many


def _reach(lists: Column, k: int) -> Column:
    """Distance within which the row itself and k others lie, from an array of (distance, weight); far if there are fewer."""
    start = F.struct(F.lit(0).cast("bigint").alias("w"), F.lit(FAR).cast("bigint").alias("r"))
    step = lambda acc, e: F.when(acc["w"] > k, acc).otherwise(F.struct((acc["w"] + e["many"]).alias("w"), e["dist"].alias("r")))
    return F.aggregate(F.array_sort(lists), start, step, lambda acc: F.when(acc["w"] > k, acc["r"]).otherwise(FAR))


def _radii(cells: DataFrame, k: int) -> DataFrame:
    """``key, a, b, w, n, r``: the distance to the kth nearest neighbour of each point.

    A point looks through its own cell first; that bounds its square.  Then it visits the other cells whose box the square
    overlaps: strips that do are found in the key's list of strips, cells in the strip's list of cells.
    """
    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, w = (pdf[c].to_numpy() for c in "abw")
        dist, many = nearest(a, b, a, b, w, k)
        return pdf.assign(dist=list(dist), many=list(many))

    near = written(cells.groupBy("key", "strip", "cell").applyInPandas(
        own, "key string, a bigint, b bigint, w bigint, n bigint, strip bigint, cell bigint, dist array<bigint>, many array<bigint>"), "near")
    boxes = near.groupBy("key", "strip", "cell").agg(*[f(c).alias(c + name) for c in "ab" for f, name in ((F.min, "lo"), (F.max, "hi"))])
    boxes = written(boxes, "boxes")
    strips = boxes.groupBy("key", F.col("strip").alias("to")).agg(F.min("alo").alias("alo"), F.max("ahi").alias("ahi"))
    strips = strips.groupBy("key").agg(F.collect_list(F.struct("to", "alo", "ahi")).alias("strips"))
    inside = boxes.groupBy("key", F.col("strip").alias("to")).agg(F.collect_list(F.struct("cell", "alo", "ahi", "blo", "bhi")).alias("boxes"))

    r = lambda c: (F.col(c) - F.col("r"), F.col(c) + F.col("r"))
    overlaps = lambda box, c: (box[c + "hi"] > r(c)[0]) & (box[c + "lo"] < r(c)[1])
    lists = F.arrays_zip("dist", "many")
    seekers = near.select(*POINT, "strip", "cell", _reach(lists, k).alias("r")).filter("r > 0")
    seekers = join_small(seekers, strips, ["key"]).withColumn("to", F.explode(F.transform(
        F.filter("strips", lambda s: overlaps(s, "a")), lambda s: s["to"]))).drop("strips")
    seekers = join_small(seekers, inside, ["key", "to"]).withColumn("into", F.explode(F.transform(F.filter("boxes", lambda box: (
        overlaps(box, "a") & overlaps(box, "b") & ~((F.col("to") == F.col("strip")) & (box["cell"] == F.col("cell"))))),
        lambda box: box["cell"])))
    visits = written(seekers.select(*POINT, F.col("to").alias("strip"), F.col("into").alias("cell")), "visits")

    def visit(guests: pd.DataFrame, hosts: pd.DataFrame) -> pd.DataFrame:
        if guests.empty:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in (*POINT, "dist", "many")})
        dist, many = nearest(guests["a"].to_numpy(), guests["b"].to_numpy(), *(hosts[c].to_numpy() for c in "abw"), k)
        return guests[POINT].assign(dist=list(dist), many=list(many))

    by = ["key", "strip", "cell"]
    seen = visits.groupBy(*by).cogroup(near.select(*POINT, "w", "strip", "cell").groupBy(*by)).applyInPandas(
        visit, "key string, a bigint, b bigint, dist array<bigint>, many array<bigint>")
    stacked = near.select(*POINT, "w", "n", lists.alias("near")).unionByName(seen.select(*POINT, lists.alias("near")), allowMissingColumns=True)
    return stacked.groupBy(*POINT).agg(F.max("w").alias("w"), F.max("n").alias("n"), _reach(F.flatten(F.collect_list("near")), k).alias("r"))


def _range_counts(points: DataFrame) -> DataFrame:
    """``key, n, w, dim, c``: per point and column, the rows closer than ``r`` in that column (equal ones, where r is 0).

    The values and both ends of every range are sorted together, by ranges of the whole order that each hold about as many
    rows, with a running sum of the weights; a range holds the difference of the sums at its ends.
    """
    slack = F.greatest(F.col("r") - 1, F.lit(0))
    entry = lambda c, shift, kind: F.struct(F.lit(c).alias("dim"), shift.alias("v"), F.lit(kind).alias("kind"))
    rows = points.withColumn("e", F.explode(F.array(*[entry(c, v, kind) for c in "ab" for v, kind in (
        (F.col(c) - slack, LOW), (F.col(c), VALUE), (F.col(c) + slack, HIGH))]))).select(*POINT, "w", "n", "e.*")
    order = ["key", "dim", "v", "kind", "a", "b"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def running(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, last = 0, None
        for pdf in frames:
            if len(pdf):
                sums = total + pdf["w"].where(pdf["kind"] == VALUE, 0).cumsum()
                total, last = int(sums.iloc[-1]), pdf.iloc[[-1]]
                yield pdf.assign(upto=sums)[pdf["kind"] != VALUE]
        if last is not None:
            yield last.assign(kind=TOTAL, upto=total)

    sums = written(rows.mapInPandas(running, StructType([*rows.schema, StructField("upto", LongType())])), "running")
    totals = sums.filter(F.col("kind") == TOTAL).select("part", "upto")  # one row per task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("upto").over(before), F.lit(0)).alias("earlier"))
    ends = join_small(sums.filter(F.col("kind") != TOTAL), offsets, ["part"])
    signed = (F.col("upto") + F.col("earlier")) * F.when(F.col("kind") == HIGH, 1).otherwise(-1)
    return ends.groupBy(*POINT, "dim").agg(F.max("n").alias("n"), F.max("w").alias("w"), F.sum(signed).alias("c"))


def neighbour_information(df: DataFrame, key: str, a: str, b: str, k: int = 3, cell: int = 1024) -> DataFrame:
    """``key, n, mi``: mutual information of ``a`` and ``b`` in nats, per key, by the kth nearest neighbours (at least 0).

    digamma(n) + digamma(k) - mean(digamma(n_a) + digamma(n_b)), where n_a counts the row itself and the rows whose ``a`` is closer
    than the kth neighbour; where that is at distance 0, the rows with the same ``a``.  Rows with a NULL key, or whose ``a`` or
    ``b`` is NULL, NaN or infinite, are left out; a key without k + 1 rows has NULL; an empty table gives no row.  No pair of
    rows is written: a point meets the ``cell`` points of its own cell and of those that its square overlaps.
    """
    if k < 1 or cell <= k:
        raise ValueError("k must be positive and cell larger than k")
    points = _points(df, key, a, b)
    points = written(_radii(_cells(points, cell), k), "radii")
    sums = _range_counts(points).groupBy("key", "n").agg(F.sum(F.col("w") * digamma(F.col("c"))).alias("s"))
    mi = digamma(F.col("n")) + digamma(F.lit(k)) - F.col("s") / F.col("n")
    return sums.select(F.col("key").alias(key), "n", F.when(F.col("n") > k, F.greatest(mi, F.lit(0.0))).alias("mi"))
