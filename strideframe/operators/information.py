"""Mutual information of discrete columns, from counts alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _clogc(counts: DataFrame, keys: list[str], out: str) -> DataFrame:
    c = F.col("c").cast("double")
    return counts.groupBy(*keys).agg(F.sum(c * F.log(c)).alias(out), F.sum("c").alias("n"), F.count(F.lit(1)).alias("k_" + out))


def mutual_information(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """``keys, n, h_a, h_b, h_ab, mi`` in nats.

    Entropies are log n - sum(c log c) / n, so that the joint and the two marginal counts are plain
    aggregates (of the joint counts), and nothing has to be joined back to the rows.
    """
    counts = df.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("c"))
    sides = [_clogc(counts, keys, "ab")]
    for col, out in ((a, "a"), (b, "b")):
        sides.append(_clogc(counts.groupBy(*keys, col).agg(F.sum("c").alias("c")), keys, out))
    stacked = sides[0].unionByName(sides[1], allowMissingColumns=True).unionByName(sides[2], allowMissingColumns=True)
    names = ("ab", "a", "b")
    out = stacked.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(c).alias(c) for x in names for c in (x, "k_" + x)])
    h = {x: F.log(F.col("n").cast("double")) - F.col(x) / F.col("n") for x in names}
    return out.select(*keys, "n", "k_a", "k_b", h["a"].alias("h_a"), h["b"].alias("h_b"), h["ab"].alias("h_ab"),
                      F.greatest(h["a"] + h["b"] - h["ab"], F.lit(0.0)).alias("mi"))


def normalized_mutual_information(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Mutual information over the arithmetic mean of the entropies.

    Two constant columns agree perfectly (1); otherwise no information is 0.
    """
    mi = mutual_information(df, keys, a, b)
    both = (F.col("k_a") == 1) & (F.col("k_b") == 1)
    mean = (F.col("h_a") + F.col("h_b")) / 2
    return mi.withColumn("nmi", F.when(both, 1.0).when(F.col("mi") <= 2.220446049250313e-16, 0.0).otherwise(F.col("mi") / mean))
