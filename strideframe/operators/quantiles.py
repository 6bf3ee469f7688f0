"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..series import join_small
from ..tables import written

ACCURACY = 10_000
PARTS = 256


def exact_quantiles(df: DataFrame, keys: list[str], col: str, qs: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """Exact, linearly interpolated quantiles ``{output: q}`` per key group; one row per group.

    ``percentile`` keeps every distinct value of a group in one task, which a group holding a third
    of a large table does not allow.  Instead:

    1. an approximate sketch brackets each wanted order statistic (its rank error is at most n / accuracy);
    2. the bracket edges of a group, in order, cut its values into slots: each row falls into one slot, and is counted by
       (slot, value) inside a bracket and by slot alone outside;
    3. the values of a slot are cut into ``PARTS`` parts of about as many distinct values each, and running counts over slots and
       parts tell which parts hold the wanted ranks;
    4. only the values in those parts are ranked one by one.

    Two scans of ``df``, each row once in either, and no task ranks more than about 8 n / (accuracy * PARTS) distinct values of a
    group, however its values are spread.  NULLs are left out.
    """
    names = sorted(qs, key=qs.get)
    shares = [float(qs[name]) for name in names]
    slack = 4.0 / accuracy  # the sketch errs by at most n / accuracy ranks, and a neighbour is one rank away
    probes = sorted({p for q in shares for p in (max(0.0, q - slack), min(1.0, q + slack))})
    at = {p: i for i, p in enumerate(probes)}
    data = df.select(*keys, F.col(col).alias("_v")).filter("_v is not null")
    sketch = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                     F.percentile_approx("_v", probes, accuracy).alias("_a"))
    # a small group is its own bracket; the extreme probes must not cut off the extreme order statistics
    small = F.col("_n") <= accuracy
    edge = lambda p, extreme, beyond: F.col(extreme) if beyond else F.when(small, F.col(extreme)).otherwise(F.col("_a")[at[p]])
    lows = F.array(*[edge(max(0.0, q - slack), "_min", q <= slack) for q in shares])
    highs = F.array(*[edge(min(1.0, q + slack), "_max", q >= 1 - slack) for q in shares])
    passed = F.size(F.filter("_lows", lambda e: e <= F.col("_v")))
    left = F.size(F.filter("_highs", lambda e: e < F.col("_v")))
    rows = join_small(data, sketch.select(*keys, "_n", lows.alias("_lows"), highs.alias("_highs")), keys)
    rows = rows.select(*keys, "_n", (passed + left).alias("_slot"), F.when(passed > left, F.col("_v")).alias("_v"))
    counts = written(rows.groupBy(*keys, "_n", "_slot", "_v").agg(F.count(F.lit(1)).alias("_c")), "counts")

    in_order = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = counts.groupBy(*keys, "_slot").agg(F.sum("_c").alias("_c"))
    slots = slots.select(*keys, "_slot", F.coalesce(F.sum("_c").over(in_order), F.lit(0)).alias("_start"))
    inside = counts.filter("_v is not null")
    edges = inside.groupBy(*keys, "_slot").agg(F.percentile_approx("_v", [i / PARTS for i in range(1, PARTS)], accuracy).alias("_e"))
    inside = inside.join(edges.join(slots, [*keys, "_slot"]), [*keys, "_slot"])
    inside = inside.withColumn("_part", F.size(F.filter("_e", lambda e: e <= F.col("_v")))).drop("_e")

    def wanted(n):
        """Both neighbours of each order statistic, as (quantile, rank)."""
        want = lambda q: F.lit(q) * (n - 1)
        return F.array(*[F.struct(F.lit(2 * i + up).alias("which"), r(want(q)).cast("bigint").alias("rank"))
                         for i, q in enumerate(shares) for up, r in ((0, F.floor), (1, F.ceil))])

    held = lambda: F.filter(wanted(F.col("_n")), lambda w: (w["rank"] >= F.col("_from")) & (w["rank"] < F.col("_from") + F.col("_c")))
    before = Window.partitionBy(*keys, "_slot").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = inside.groupBy(*keys, "_n", "_slot", "_start", "_part").agg(F.sum("_c").alias("_c"))
    parts = parts.withColumn("_from", F.col("_start") + F.coalesce(F.sum("_c").over(before), F.lit(0))).filter(F.size(held()) > 0)
    ranked = inside.drop("_start").join(parts.select(*keys, "_slot", "_part", F.col("_from").alias("_start")), [*keys, "_slot", "_part"])
    before = Window.partitionBy(*keys, "_slot", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("_from", F.col("_start") + F.coalesce(F.sum("_c").over(before), F.lit(0)))
    hits = ranked.select(*keys, "_n", "_v", F.explode(held()).alias("_w"))
    side = lambda i: F.max(F.when(F.col("_w.which") == i, F.col("_v")))
    found = hits.groupBy(*keys, "_n").agg(*[side(i).alias(f"_s{i}") for i in range(2 * len(names))])
    out = {}
    for i, (name, q) in enumerate(zip(names, shares)):
        lo, hi, want = F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}"), F.lit(q) * (F.col("_n") - 1)
        missed = F.raise_error(F.lit(f"the bracket of quantile {q} missed its rank")).cast("double")
        out[name] = F.when(lo.isNull() | hi.isNull(), missed).otherwise(lo + (hi - lo) * (want - F.floor(want))).alias(name)
    return found.select(*keys, *[out[name] for name in qs])
