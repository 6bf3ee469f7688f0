"""Suffix-array deduplication: every byte covered by a string of ``length`` bytes that also starts elsewhere is removed.

Distributed prefix doubling on a synchronised sample of positions.  The rank of a position is the class of the string of
``h`` bytes that starts there; the rank at ``2h`` is the class of the pair (rank here, rank ``h`` further on).

1. Inside a task ranks double from 1 byte to ``GRAM`` bytes.  Of the grams in each window of ``length`` bytes the least rank is
   the window's anchor; neighbouring windows with one anchor form a run.  The choice depends on the window's bytes alone, so
   equal windows have equal anchors.
2. Spark ranks the anchors: an anchor that occurs once is unique, and its run leaves.  The rest, some tenth of a row per
   byte of repeated text, is ranked at the offset of the whole run: runs whose bytes are the same as another's are covered.
3. Runs of an anchor that agree with no other run as a whole are compared window by window: their pairs (rank of the first
   half, rank of the second half, at offset ``length / 2``) are sorted, and a pair that occurs twice is a repeated string.
   One row stands for all equal runs.  Anchors with up to ``GROUP`` different runs are compared side by side in a task.
   Of the others, ranges of 64, 8 and 1 windows are ranked by the strings that their windows share (137, 193 and 200 bytes),
   and cut while they differ.

Ranks are 64-bit hashes of pairs, so no table of ranks travels; classes are told apart by 128 bits at least.  Texts travel
twice, and only those of documents with repeated anchors where Spark's runtime filter applies.

Defined results: a null text is empty; a text shorter than ``length`` keeps all; strings repeated inside one document count;
rows that repeat an id are texts of their own where they differ (named by a hash of id and text), and one text where they are
equal; a row without id is named by a hash of its text; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm.shared import as_text, has_repeats, written

LENGTH, GRAM, GROUP, CUT = 200, 48, 512, 3
C1, C2, HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


@contextmanager
def runtime_filter(spark: SparkSession, scan: str = "1MB", keys: str = "10GB"):
    """Inside, Spark may filter a scan of ``scan`` or more by a Bloom filter of the other side's keys, whose table has ``keys`` at
    most.  The filter itself is 8 MB at most by Spark's own limit; keys in excess only make it let more rows through."""
    own = "spark.sql.optimizer.runtime.bloomFilter."
    new = {own + "applicationSideScanSizeThreshold": scan, own + "creationSideThreshold": keys}
    before = {name: spark.conf.get(name) for name in new}
    for name, value in new.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def pair_rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * C1
        x += b
        x ^= x >> HALF
        x *= C2
        x ^= x >> HALF
    return x


def ranks(data: np.ndarray, h: int) -> np.ndarray:
    """Rank at each position of the ``h`` bytes from there: doubling, the last step with overlap."""
    with np.errstate(over="ignore"):
        r = (data.astype(np.uint64) + np.uint64(1)) * C2
    r ^= r >> HALF
    m = 1
    while m < h:
        step = min(m, h - m)
        r, m = pair_rank(r[:-step], r[step:]), m + step
    return r


def least(r: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbouring ranks, by doubling as well."""
    m = 1
    while m < w:
        step = min(m, w - m)
        r, m = np.minimum(r[:-step], r[step:]), m + step
    return r


def runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchor, start, count, places`` of each run of windows: places is how often the anchor occurs in the run's bytes."""
    r = ranks(data, gram)
    anchor = least(r, length - gram + 1)
    start = np.append(0, np.flatnonzero(anchor[1:] != anchor[:-1]) + 1)
    count = np.diff(np.append(start, len(anchor)))
    span = count + (length - gram)
    first = np.cumsum(span) - span
    at = np.arange(int(span.sum())) - np.repeat(first - start, span)
    places = np.add.reduceat((r[at] == np.repeat(anchor[start], span)).astype(np.int32), first)
    return anchor[start], start, count, places


RUN_ARROW = pa.schema([("doc", pa.int64()), ("anchor", pa.int64()), ("whole", pa.int64()), ("start", pa.int32()), ("count", pa.int32()), ("places", pa.int32())])
RUN_SCHEMA = "doc bigint, anchor bigint, whole bigint, start int, count int, places int"


def all_runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[list[np.ndarray]] = [[] for _ in RUN_ARROW]
            rows = 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = text.as_py()
                if len(raw) < length:
                    continue
                anchor, start, count, places = runs(np.frombuffer(raw, np.uint8), length, gram)
                view = memoryview(raw)
                whole = [int.from_bytes(hashlib.blake2b(view[s:s + c + length - 1], digest_size=8).digest(), "little", signed=True)
                         for s, c in zip(start.tolist(), count.tolist())]
                for to, x in zip(held, (np.full(len(start), doc), anchor.view(np.int64), np.array(whole, np.int64), start.astype(np.int32), count.astype(np.int32), places)):
                    to.append(x)
                rows += len(start)
                if rows > 65536:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in held], schema=RUN_ARROW)
                    held, rows = [[] for _ in RUN_ARROW], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in held], schema=RUN_ARROW)

    return texts.mapInArrow(run, RUN_SCHEMA)


def windows(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of all pieces: the piece, the offset in it, and the pair of ranks of its halves."""
    half = length // 2
    sizes = np.array([len(p) for p in pieces])
    r = ranks(np.frombuffer(b"".join(pieces), np.uint8), length - half)
    count = sizes - length + 1
    first = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(pieces)), count)
    offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at = first[piece] + offset
    return piece, offset, r[at], r[at + half]


def intervals(piece: np.ndarray, offset: np.ndarray, repeated: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, from and to of the bytes under each stretch of repeated windows."""
    piece, offset = piece[repeated], offset[repeated]
    if not len(piece):
        return piece, offset, offset
    first = np.append(True, (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1))
    last = np.append(first[1:], True)
    return piece[first], offset[first], offset[last] + length


COVER_ARROW = pa.schema([("doc", pa.int64()), ("from", pa.int32()), ("to", pa.int32())])
COVER_SCHEMA = "doc bigint, `from` int, `to` int"


def side_by_side(rows: DataFrame, length: int) -> DataFrame:
    """Covered bytes of the single runs in ``(anchor, copies, doc, start, piece)``, whose anchors have few runs each."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        piece, offset, a, b = windows(table.column("piece").to_pylist(), length)
        copies, doc, start = (table.column(c).to_numpy() for c in ("copies", "doc", "start"))
        order = np.lexsort((b, a))
        new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        twice = np.bincount(group, weights=copies[piece])[group] >= 2
        p, lo, hi = intervals(piece, offset, twice & (copies[piece] == 1), length)
        return pa.RecordBatch.from_arrays([pa.array(doc[p]), pa.array((start[p] + lo).astype(np.int32)), pa.array((start[p] + hi).astype(np.int32))], schema=COVER_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:  # sorted by anchor: an anchor may go on in the next batch
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                anchors = b.column(0).to_numpy()
                cut = int(np.searchsorted(anchors, anchors[-1])) if len(anchors) else 0
                if rows + cut >= 2048 and (cut or (held and held[-1].column(0)[-1].as_py() != anchors[0])):
                    yield solve(pa.Table.from_batches([*held, b.slice(0, cut)]))
                    held, rows, b = [], 0, b.slice(cut)
                held.append(b)
                rows += b.num_rows
        if rows:
            yield solve(pa.Table.from_batches(held))

    few = rows.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "copies", "doc", "start", "piece")
    return few.mapInArrow(run, COVER_SCHEMA)


RANGE_ARROW = pa.schema([("core", pa.binary()), ("body", pa.binary()), ("copies", pa.int64()), ("doc", pa.int64()), ("at", pa.int32()), ("from", pa.int32()), ("to", pa.int32()),
                        ("low", pa.int32()), ("high", pa.int32()), ("piece", pa.binary())])
RANGE_SCHEMA = "core binary, body binary, copies bigint, doc bigint, at int, `from` int, `to` int, low int, high int, piece binary"


def leftmost(r: np.ndarray, w: int) -> np.ndarray:
    """Where the first minimum of each ``w`` neighbouring ranks is."""
    at, m = np.arange(len(r)), 1
    while m < w:
        step = min(m, w - m)
        a, b = at[:-step], at[step:]
        at, m = np.where(r[a] <= r[b], a, b), m + step
    return at


def aligned(batch: pa.RecordBatch, length: int, gram: int) -> Iterator[tuple]:
    """``copies, doc, at, from, low, high, piece``: the windows of each run by the place of their first least gram, ``at``.

    A window is known by its distance to that gram, ``low`` to ``high`` here; equal windows have equal distances.
    """
    for copies, doc, start, piece in zip(*(batch.column(c).to_pylist() for c in ("copies", "doc", "start", "piece"))):
        at = leftmost(ranks(np.frombuffer(piece, np.uint8), gram), length - gram + 1)
        first = np.append(0, np.flatnonzero(np.diff(at)) + 1)
        for i, j in zip(first.tolist(), np.append(first[1:], len(at)).tolist()):
            p = int(at[i])
            yield copies, doc, start + p, start + i, p - j + 1, p - i, piece[i:j - 1 + length]


def ranges(rows: DataFrame, level: int, length: int, gram: int, first: bool) -> DataFrame:
    """The windows of each row in aligned ranges of ``2 ** level`` distances.

    ``body`` names the bytes under the windows that the row has of a range, ``core`` those that all windows of the range share: an equal
    window elsewhere has an equal core.
    """
    names = ("copies", "doc", "at", "from", "low", "high", "piece")

    def digest(data: bytes, *tags: int) -> bytes:
        return hashlib.blake2b(data, digest_size=16, person=np.array(tags, np.int16).tobytes()).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                b, out = batch.slice(i, 4096), []
                for copies, doc, at, begin, low, high, piece in aligned(b, length, gram) if first else zip(*(b.column(c).to_pylist() for c in names)):
                    for k in range(low >> level, (high >> level) + 1):
                        a, z = k << level, min(((k + 1) << level) - 1, length - gram)
                        lo, hi = max(a, low), min(z, high)
                        body = piece[at - hi - begin:at - lo + length - begin]
                        out.append((digest(piece[at - a - begin:at - z + length - begin], a, z), digest(body, lo, hi), copies, doc, at, at - hi, at - lo + length, lo, hi, body))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), RANGE_ARROW)], schema=RANGE_ARROW)

    return rows.mapInArrow(run, RANGE_SCHEMA)


def by_ranges(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Covered bytes of the single runs of anchors with many runs.

    Ranges of windows around an anchor are compared as wholes and cut into eighths as long as they differ.  A range whose core occurs
    once leaves: none of its windows is repeated.  A range whose body occurs twice is covered; one row stands for it from then on.
    Cores grow towards the length of a window as ranges shrink to one, counts are partial aggregates, and a group without a single
    range left is done.
    """
    spans, left = None, rows
    for turn, level in enumerate(range(((length - gram).bit_length() - 1) // CUT * CUT, -1, -CUT)):
        made = written(ranges(left, level, length, gram, turn == 0), "ranges")
        row = F.struct("doc", "at", "from", "low", "high", "piece")
        bodies = written(made.groupBy("core", "body").agg(F.sum("copies").alias("n"), F.min(row).alias("one")), "bodies")
        found = made.filter("copies = 1").join(bodies.filter("n > 1").select("core", "body"), ["core", "body"], "left_semi").select("doc", "from", "to")
        spans = found if spans is None else spans.union(found)
        single = bodies.groupBy("core").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("kinds")).filter("least = 1 and kinds > 1").select("core")
        left = bodies.join(single, "core", "left_semi").select(F.col("n").alias("copies"), "one.*")
    return spans


def repeated_bytes(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept``: one row per row.

    ``spans`` (array<struct<from, to>>, byte offsets) are the removed runs, null where there are none; ``kept`` are the
    remaining bytes of such rows, null elsewhere (the text itself is what remains).
    """
    spark = docs.sparkSession
    raw = as_text(text)
    name = F.coalesce(F.col(id).cast("bigint"), F.xxhash64(raw))
    if has_repeats(docs, id):
        again = written(docs.filter(F.col(id).isNotNull()).groupBy(F.col(id).cast("bigint").alias("again")).count().filter("count > 1").select("again"), "repeated-ids")
        docs = docs.select(F.col(id).cast("bigint").alias("doc_id"), raw.alias("text")).join(again, F.col("doc_id") == F.col("again"), "left")
        raw, id = F.col("text"), "doc_id"
        name = F.when(F.col("again").isNotNull(), F.xxhash64("doc_id", "text")).otherwise(F.coalesce("doc_id", F.xxhash64("text")))
    texts = docs.select(name.alias("doc"), raw.cast("binary").alias("raw"))
    found = written(all_runs(texts, length, gram), "runs")
    twice = written(found.groupBy("anchor").agg(F.sum("places").alias("n")).filter("n > 1"), "anchors")
    found = written(found.join(twice.filter("n > 1").select("anchor").hint("merge"), "anchor", "left_semi"), "repeated-runs")
    classes = written(found.groupBy("anchor", "whole", "count").agg(F.count(F.lit(1)).alias("copies"), F.max("places").alias("places"),
                                                                     F.min(F.struct("doc", "start")).alias("one")), "classes")
    # whole runs that occur twice
    same = classes.filter("copies > 1").select("anchor", "whole", "count")
    covered = [found.join(same.hint("merge"), ["anchor", "whole", "count"], "left_semi").select("doc", F.col("start").alias("from"), (F.col("start") + F.col("count") + length - 1).alias("to"))]
    # runs that differ from some run of their anchor, or hold their anchor twice
    differ = (classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("places").alias("most"), F.min("copies").alias("least"))
              .filter("(kinds > 1 or most > 1) and least = 1").select("anchor", "kinds"))
    tests = written(classes.join(written(differ, "differ").hint("merge"), "anchor").select("anchor", "kinds", "copies", F.col("one.doc").alias("doc"), F.col("one.start").alias("start"), "count"), "tests")
    with runtime_filter(spark):
        bodies = texts.dropDuplicates(["doc"]) if has_repeats(texts, "doc") else texts
        cut = bodies.join(tests.filter("kinds > 0").hint("merge"), "doc").select(
            "anchor", "kinds", "copies", "doc", "start", F.substring("raw", F.col("start") + 1, F.col("count") + length - 1).alias("piece"))
        cut = written(cut, "pieces")
    covered.append(side_by_side(cut.filter(F.col("kinds") <= group), length))
    if cut.filter(F.col("kinds") > group).limit(1).count():
        covered.append(by_ranges(cut.filter(F.col("kinds") > group).select("copies", "doc", "start", "piece"), length, gram))
    spans = covered[0]
    for more in covered[1:]:
        spans = spans.union(more)
    spans = written(spans.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("spans"), F.count(F.lit(1)).alias("n")), "spans")

    kinds = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                       ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32())), ("kept", pa.binary())])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, cover in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                body = text.as_py()
                lo, hi = cover.values.field("from").to_numpy(), np.maximum.accumulate(cover.values.field("to").to_numpy())
                new = np.append(True, lo[1:] > hi[:-1])  # touching runs are one
                lo, hi = lo[new], hi[np.append(new[1:], True)]
                edges = np.stack([np.append(0, hi), np.append(lo, len(body))], 1).tolist()
                kept = b"".join(body[s:e] for s, e in edges)
                out.append((doc, len(body), len(body) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), lo, hi, kept))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds.types)] if out else [pa.array([], k) for k in kinds.types], schema=kinds)

    schema = "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, lo array<int>, hi array<int>, kept binary"
    with runtime_filter(spark):
        stripped = written(bodies.join(spans.filter("n > 0").select("doc", "spans").hint("merge"), "doc").select("doc", "raw", "spans").mapInArrow(strip, schema), "stripped")
    rows = docs.select(F.col(id).alias("doc_id"), name.alias("doc"),
                       F.octet_length(raw).cast("bigint").alias("bytes"), F.sha2(raw, 256).alias("sha"))
    return rows.join(stripped.drop("n_bytes").hint("merge"), "doc", "left").select(
        "doc_id", F.col("bytes").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        F.arrays_zip(F.col("lo").alias("from"), F.col("hi").alias("to")).alias("spans"), "kept")
