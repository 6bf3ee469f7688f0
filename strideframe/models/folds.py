"""Cross-validation folds as tables: every row of a table once per fold, with its role."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import idiv
from ..series import dense_positions, join_small

PRIME = 2_147_483_647


def mix(value: Column, seed: int) -> Column:
    """Pseudo-random integer in 0 .. PRIME-1 by modular arithmetic (any SQL engine gives the same)."""
    v = F.pmod(value.cast("bigint") * 104_729 + seed * 7_919 + 12_345, F.lit(PRIME))
    for _ in range(3):
        v = F.pmod(v * 48_271, F.lit(PRIME))
        v = F.pmod(v * v + v + 1, F.lit(PRIME))
    return v


def block_fragments(spark: SparkSession, n: int, n_splits: int = 10, fragmentation: float = 0.1, pad: int = 15, seed: int = 0,
                    repeat: int = 0) -> DataFrame:
    """``fold, fragment, start, end, pad_start, pad_end``: the test fragments of a repeated random block split.

    Each fold draws its fragments by itself, so that folds may overlap.  Around a fragment, ``pad``
    rows on both sides are kept out of the training rows, since windows that overlap share signal.
    """
    if isinstance(n_splits, bool) or not isinstance(n_splits, int):
        raise ValueError(f"n_splits must be a whole number, not {n_splits!r}")
    test = n // n_splits
    fragments = max(1, int(test * fragmentation))
    length = max(1, test // fragments)
    room = n - 1 - length - pad
    if room <= 0:
        raise ValueError(f"{n} rows leave no room for a test fragment of {length} rows with padding {pad}")
    ids = spark.range(n_splits * fragments)
    start = F.lit(pad) + F.pmod(mix(F.col("id") + repeat * 1_000_003, seed), F.lit(room))
    df = ids.select(idiv("id", fragments).cast("int").alias("fold"), F.pmod("id", F.lit(fragments)).alias("fragment"), start.alias("start"))
    df = df.withColumn("end", F.least(F.col("start") + length, F.lit(n - 1)))
    return df.withColumn("pad_start", F.greatest(F.col("start") - pad, F.lit(0))).withColumn("pad_end", F.least(F.col("end") + pad, F.lit(n - 1)))


def block_folds(df: DataFrame, n: int, n_splits: int = 10, fragmentation: float = 0.1, pad: int = 15, seed: int = 0, repeat: int = 0,
                pos: str = "pos", empty_test: str = "train") -> DataFrame:
    """Rows of ``df`` with ``fold`` and ``role``: "test", "train", or "pad" for rows kept out of both.

    With a single split there is no test part: the rows then train, and also test if ``empty_test`` is
    "train" ("skip": they only train).
    """
    if n_splits == 1:
        roles = ["train", "test"] if empty_test == "train" else ["train"]
        return df.withColumn("fold", F.lit(0)).withColumn("role", F.explode(F.array(*[F.lit(r) for r in roles])))
    fragments = block_fragments(df.sparkSession, n, n_splits, fragmentation, pad, seed, repeat)
    off = F.col(pos) - idiv(pos, ROLE_BLOCK) * ROLE_BLOCK
    rows = join_small(df.withColumn("_blk", idiv(pos, ROLE_BLOCK)), block_roles(fragments, n_splits), ["_blk"], how="left")
    rows = rows.withColumn("_here", F.substr("_roles", (off * n_splits + 1).cast("int"), F.lit(n_splits))).drop("_blk", "_roles")
    code = F.substr("_here", F.col("fold") + 1, F.lit(1))
    role = F.when(code == F.lit(bytearray([TEST])), "test").when(code == F.lit(bytearray([PAD])), "pad").otherwise("train")
    return _per_fold(rows, n_splits).withColumn("role", role).drop("_here")


ROLE_BLOCK, PAD, TEST = 4096, 1, 2


def block_roles(fragments: DataFrame, n_splits: int, block: int = ROLE_BLOCK) -> DataFrame:
    """``_blk, _roles``: for each block of positions that a padded fragment touches, one byte per (position, fold).

    A sweep per block: every fragment is cut to the blocks it touches, its ends raise and lower a count of open fragments, and the
    running count tells the role.  So there is a row per (fragment, block it touches), and then one per block.
    """
    first, last = idiv("pad_start", block), idiv(F.col("pad_end") - 1, block)
    parts = fragments.filter("pad_end > pad_start").withColumn("_blk", F.explode(F.sequence(first, last)))
    inside = lambda c: F.least(F.greatest(F.col(c) - F.col("_blk") * block, F.lit(0)), F.lit(block)).cast("int").alias(c)
    parts = parts.groupBy("_blk").agg(F.collect_list(F.struct("fold", *(inside(c) for c in ("pad_start", "pad_end", "start", "end")))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles = []
            for own in b.column(1):
                v = own.values
                fold, lo, hi, test_lo, test_hi = (v.field(c).to_numpy() for c in ("fold", "pad_start", "pad_end", "start", "end"))
                opened = np.zeros((2, block + 1, n_splits), np.int32)
                for i, (a, z) in enumerate(((lo, hi), (test_lo, test_hi))):
                    np.add.at(opened[i], (a, fold), 1)
                    np.add.at(opened[i], (z, fold), -1)
                near, test = np.cumsum(opened, axis=1)[:, :block] > 0
                roles.append(np.where(test, TEST, np.where(near, PAD, 0)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(roles, pa.binary())], names=["_blk", "_roles"])

    return parts.mapInArrow(run, "_blk bigint, _roles binary")


def _per_fold(df: DataFrame, n_splits: int) -> DataFrame:
    return df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))


def _rotate(df: DataFrame, n_splits: int, test_fold: str) -> DataFrame:
    return (_per_fold(df, n_splits).withColumn("role", F.when(F.col("fold") == F.col(test_fold), "test").otherwise("train"))
            .drop(test_fold))


def _contiguous(rank: Column, n: int, k: int) -> Column:
    """Part of a row when n rows are cut into k parts; the first n mod k parts hold one more."""
    small, large = n // k, n % k
    cut = large * (small + 1)
    return F.when(rank < cut, F.floor(rank / (small + 1))).otherwise(F.floor((rank - cut) / max(small, 1)) + large).cast("int")


def _shuffled_rank(df: DataFrame, pos: str, seed: int, keys: list[str] = ()) -> DataFrame:
    """Rank in a seeded random order; no task sorts the table."""
    df = df.withColumn("_h", F.struct(mix(F.col(pos), seed).alias("h"), F.col(pos).alias("p")))
    return dense_positions(df, list(keys), "_h", "_rank").drop("_h")


def k_fold(df: DataFrame, n: int, n_splits: int = 5, shuffle: bool = False, seed: int = 0, pos: str = "pos") -> DataFrame:
    df = _shuffled_rank(df, pos, seed) if shuffle else df.withColumn("_rank", F.col(pos))
    return _rotate(df.withColumn("_part", _contiguous(F.col("_rank"), n, n_splits)).drop("_rank"), n_splits, "_part")


def stratified_k_fold(df: DataFrame, label: str, n_splits: int = 5, shuffle: bool = False, seed: int = 0, pos: str = "pos") -> DataFrame:
    """The rows of each label are dealt to the folds in turn."""
    df = (_shuffled_rank(df, pos, seed, [label]) if shuffle
          else dense_positions(df, [label], pos, "_rank"))
    return _rotate(df.withColumn("_part", F.pmod("_rank", F.lit(n_splits)).cast("int")).drop("_rank"), n_splits, "_part")


def repeated(split, n_repeats: int, n_splits: int, seed: int = 0, **params) -> DataFrame:
    """Repeat a shuffled split with different seeds; fold numbers run on."""
    out = None
    for r in range(n_repeats):
        part = split(n_splits=n_splits, shuffle=True, seed=seed + r, **params).withColumn("fold", F.col("fold") + r * n_splits)
        out = part if out is None else out.unionByName(part)
    return out


def time_series_split(df: DataFrame, n: int, n_splits: int = 5, pos: str = "pos") -> DataFrame:
    """Fold i tests the i-th of the last ``n_splits`` blocks and trains on everything before it."""
    size = n // (n_splits + 1)
    start = (n - n_splits * size) + F.col("fold") * size
    role = F.when(F.col(pos) < start, "train").when(F.col(pos) < start + size, "test")
    return _per_fold(df, n_splits).withColumn("role", role).filter(F.col("role").isNotNull())


def thrown_out(folds: DataFrame, n: int) -> DataFrame:
    """Share of the rows (per cent) that a fold uses neither to train nor to test."""
    used = F.count(F.when(F.col("role") != "pad", 1))
    return folds.groupBy("fold").agg(((F.lit(n) - used) * 100 / n).alias("thrown_out"))


def unused_rows(folds: DataFrame, all_rows: DataFrame, n_splits: int, pos: str = "pos") -> DataFrame:
    """``fold, pos`` of the rows in neither part of a fold: all rows minus the union of train and test."""
    used = folds.filter(F.col("role") != "pad").select("fold", pos)
    return _per_fold(all_rows.select(pos), n_splits).select("fold", pos).subtract(used)


SPLITS = {"CustomFold": block_folds, "KFold": k_fold, "StratifiedKFold": stratified_k_fold, "TimeSeriesSplit": time_series_split}
