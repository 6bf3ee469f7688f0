"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are cut into blocks of ``BLOCK`` rows, queries into blocks of ``QUERIES``.  The two meet in slots: vector blocks are
dealt to slots, query blocks go to every slot.  For each pair of blocks the vector block's components are sorted once per
dimension; a query goes down the lists (from the top where its component is positive, from the bottom where it is
negative), scores what it meets in full, and stops when the sum of ``component * list value`` at its depth, which bounds
every vector not met, is below its kth score.  A task carries each query's k best from block to block, so the bound of a block
without better vectors ends it before a row is read, and hits are written once per task (``HELD`` query blocks are carried at most,
the one used longest ago is written out first).  The k best of all tasks are found by a limited window.  A block that holds
many copies of one vector is a block like others; equal scores are ordered by id.

Defined results: a vector that is null or holds a null, a NaN or an infinity takes no part, nor does a row without id; vectors of
different lengths are never compared; vectors of length 0 score 0 with each other; rows that repeat an id are candidates of
their own, but never of a query with that id; a score beyond 64 bits is set to the nearest 64-bit number; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.shared import written

BLOCK, QUERIES, DEPTH, HELD = 2048, 512, 16, 1024
BLOCK_SCHEMA = "dim int, block bigint, ids binary, matrix binary"
BLOCK_ARROW = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("matrix", pa.binary())])
HIT_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """``(dim, block, ids, matrix)`` from ``(id, v array<double>)``: up to ``size`` vectors of one length, as float64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        number = TaskContext.get().partitionId() << 33

        def block(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids, rows = held.pop(dim)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([number], pa.int64()),
                                               pa.array([np.array(ids, dtype="<i8").tobytes()]), pa.array([np.array(rows, dtype="<f8").tobytes()])], schema=BLOCK_ARROW)

        for b in batches:
            for key, row in zip(b.column(0).to_pylist(), b.column(1)):
                v = row.values.to_numpy()
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(key)
                rows.append(v)
                if len(ids) == size:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return vectors.mapInArrow(run, BLOCK_SCHEMA)


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products.  Floats are exact below 2**53; beyond, Python's integers are used."""
    if not x.size or float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < 2.0 ** 53:
        return (x @ q).astype(np.int64)
    ints = [int(c) for c in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(r, ints)), -2**63), 2**63 - 1) for r in x], dtype=np.int64)


def threshold_top(q: np.ndarray, x: np.ndarray, ids: np.ndarray, lists: np.ndarray, values: np.ndarray, k: int, own: int,
                  kept: np.ndarray | None = None, scores: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best rows for one query, as (ids, scores), of a block and of ``kept`` with ``scores``, the best of earlier blocks.
    ``lists[i, d]`` is the row at depth i of dimension d in falling order (ties by id), ``values`` its component."""
    n, dims = x.shape
    if kept is None:
        kept, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    if not dims:
        rest = np.sort(np.append(kept, ids[ids != own]))[:k]
        return rest, np.zeros(len(rest), np.int64)
    up = q >= 0
    met, depth, fresh = np.zeros(n, bool), 0, DEPTH
    while depth < n:
        ends = np.where(up, values[max(depth - 1, 0)], values[min(n - depth, n - 1)])  # nothing not met is beyond these
        if len(kept) == k and scores[-1] > -2**63 and ends @ q + np.abs(ends) @ np.abs(q) * 1e-12 < scores[-1]:  # the float sum is off by less than that
            break
        to = min(n, depth + fresh)
        seen = np.zeros(n, bool)
        seen[lists[depth:to, up].ravel()] = True
        seen[lists[n - to:n - depth, ~up].ravel()] = True
        new = np.flatnonzero(seen & ~met)
        met |= seen
        new = new[ids[new] != own]
        kept, scores = np.append(kept, ids[new]), np.append(scores, exact_scores(x[new], q))
        best = np.lexsort((kept, -scores.astype(object) if len(scores) and scores.min() == -2**63 else -scores))[:k]
        kept, scores, depth, fresh = kept[best], scores[best], to, fresh * 2
    return kept, scores


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding",
          scale: float = 256.0, block: int = BLOCK, query_block: int = QUERIES, held: int = HELD) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest inner products of ``floor(scale * component)``."""
    usable = (f"`{id}` is not null and `{vector}` is not null and forall(`{vector}`, c -> c is not null and not isnan(c) "
              "and abs(cast(c as double)) < double('Infinity'))")

    def scaled(df: DataFrame) -> DataFrame:
        return df.filter(usable).select(F.col(id).cast("bigint").alias("id"),
                                        F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"))

    xs, qs = written(blocks(scaled(vectors), block), "vector-blocks"), written(blocks(scaled(queries), query_block), "query-blocks")
    slots = max(1, min(xs.count(), 4 * vectors.sparkSession.sparkContext.defaultParallelism))
    xs = xs.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)))
    qs = qs.select(F.col("dim"), F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"),
                   F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint"))).alias("slot"))
    pairs = xs.join(qs, ["dim", "slot"]).select("dim", "block", "ids", "matrix", "query_block", "query_ids", "query_matrix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best = None, {}  # the k best so far, by query block, the one used last at the end

        def hits(keys: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, [len(f[0]) for f in found])), pa.array(np.concatenate([f[0] for f in found])),
                                               pa.array(np.concatenate([f[1] for f in found]))], schema=HIT_ARROW)

        for b in batches:
            for row in b.to_pylist():
                if row["block"] != last:
                    ids = np.frombuffer(row["ids"], "<i8")
                    order = np.argsort(ids, kind="stable")
                    ids, x = ids[order], np.frombuffer(row["matrix"], "<f8").reshape(len(ids), row["dim"])[order]
                    lists = np.argsort(-x, axis=0, kind="stable")
                    values, last = np.take_along_axis(x, lists, 0), row["block"]
                keys = np.frombuffer(row["query_ids"], "<i8")
                _, earlier = best.pop(row["query_block"], (keys, [(None, None)] * len(keys)))
                queries_here = np.frombuffer(row["query_matrix"], "<f8").reshape(len(keys), row["dim"])
                best[row["query_block"]] = keys, [threshold_top(q, x, ids, lists, values, k, own, *e) for own, q, e in zip(keys, queries_here, earlier)]
                if len(best) > held:
                    yield hits(*best.pop(next(iter(best))))
        for one in best.values():
            yield hits(*one)

    hits = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
