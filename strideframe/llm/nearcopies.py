"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidate
edges, exact confirmation on full shingle sets, connected components.

1. A document becomes its set of word shingles (64-bit hashes).  Documents with the same set are one class; only its smallest
   id goes on, so thousands of copies cost one row.
2. One hash per shingle fills ``bins`` bins with their minimum; an empty bin copies the bin that a hash of (its number, the
   attempt) points to, until it meets a filled one.  ``bands`` bands of ``rows`` bins each are hashed to bucket keys.  With
   48 bands of 6, a pair of similarity 0.75 shares no bucket with probability 8e-5, one of 0.8 with 5e-7.
3. A bucket of more than one class links each member to one centre, the member with the smallest seeded draw: as many edges
   as rows.  An edge is confirmed on the full sets: ``100 * common >= 75 * union``.  Components of confirmed links follow.
4. A bucket whose members off the centre are of several components is open.  It gets another centre from them, ``stars`` times
   in all.  What is open then is finished exactly, by a prefix filter over its members: each puts its shingles in
   one common order, rare ones first; of a similar pair, the first shingle in common is among the first
   ``n - ceil(2 p n / (100 + p)) + 1`` of the smaller set and the first ``m - ceil(p m / 100) + 1`` of the larger one, and enough
   shingles are left behind it in both.  In a family of one template the first shingles are the members' own ones.

So components are searched ``stars + 1`` times at most, whatever the data.  Every pair of two components that shares a bucket is thus compared or
known to be under ``percent``.  No pair is compared twice, and no bucket is dropped or cut.

Defined results: a text without words (or null) has an empty set and is linked with nothing; a shorter text than a shingle is
one shingle; a row without id takes no part in links and is returned as a class of its own; rows that repeat an id are
linked by their own texts (classes are named by rows, not by ids), each returned; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.shared import as_text, components, has_repeats, in_arrow, written

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SHINGLE, PERCENT, BINS, ROWS, STARS = 5, 75, 288, 6, 3
COUNTER_BITS, PIECE = 21, 1 << 16
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S27, S30, S31 = np.uint64(27), np.uint64(30), np.uint64(31)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: nearby inputs get unrelated outputs."""
    x = x ^ (x >> S30)
    x *= M1
    x ^= x >> S27
    x *= M2
    x ^= x >> S31
    return x


@cache
def donors(bins: int, attempts: int = 64) -> np.ndarray:
    """The bin that an empty bin looks at, per attempt and bin."""
    with np.errstate(over="ignore"):
        at = np.arange(bins, dtype=np.uint64) * np.uint64(0x10001) + (np.arange(1, attempts + 1, dtype=np.uint64) << np.uint64(32))[:, None]
        return (mixed(at) % np.uint64(bins)).astype(np.int64)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The document's set, as sorted 64-bit hashes."""
    words = WORDS.findall(text.encode().lower().decode())  # of bytes, lower() changes A-Z alone
    if not words:
        return np.empty(0, np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=len(words) > 64)
    n = max(1, len(h) - size + 1)
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(size, len(h))):
            out = mixed(out * np.uint64(31) + h[i:i + n])
    return np.unique(out)


def signature(sets: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One permutation, ``bins`` bins, optimal densification."""
    h = mixed(sets ^ np.uint64(0x5851F42D4C957F2D))
    h.sort()
    at = (h % np.uint64(bins)).astype(np.int64)
    sig, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    sig[at[::-1]] = h[::-1]  # the smallest is written last
    full[at] = True
    own, empty, attempt = sig.copy(), np.flatnonzero(~full), 0
    table = donors(bins)
    while len(empty):
        if attempt == len(table):
            table = donors(bins, 4 * attempt)
        to = table[attempt, empty]
        hit = full[to]
        sig[empty[hit]] = own[to[hit]]
        empty = empty[~hit]
        attempt += 1
    return sig


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band, with the band's number in it."""
    bands = sig.reshape(-1, rows)
    with np.errstate(over="ignore"):
        key = np.arange(len(bands), dtype=np.uint64) + np.uint64(1)
        for i in range(rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, i])
    return key.view(np.int64)


def sketches(docs: DataFrame, shingle: int, bins: int, rows: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, same (two 64-bit sums that name the set), bands array<long>``."""
    kinds = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("same", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, same, bands = [], [], []
            for text in b.column(2):
                s = shingles(text.as_py(), shingle)
                n.append(len(s))
                with np.errstate(over="ignore"):
                    same.append(np.array([mixed(s).sum(), mixed(s * M2 + M1).sum(), len(s)], np.uint64).tobytes() if len(s) else None)
                bands.append(band_keys(signature(s, bins), rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=kinds)

    return in_arrow(docs, run, "doc_id bigint, text_hash bigint, n_shingles bigint, same binary, bands array<bigint>")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    kinds = pa.schema([("doc_id", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), shingle).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], schema=kinds)

    return in_arrow(docs, run, "doc_id bigint, items array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that are similar enough on their full sets."""
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("xs")), sets.select(F.col("doc_id").alias("b"), F.col("items").alias("ys"))
    common = F.size(F.array_intersect("xs", "ys"))
    return (pairs.join(left, "a").join(right, "b").withColumn("common", common)
            .filter(F.col("common") * 100 >= (F.size("xs") + F.size("ys") - F.col("common")) * percent).select("a", "b"))


def counters(sets: DataFrame) -> np.ndarray:
    """How many sets have a shingle, by the shingle's last ``COUNTER_BITS`` bits: never less than the shingle's own number."""
    kinds = pa.schema([("slot", pa.int32()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << COUNTER_BITS, np.int64)
        for b in batches:
            items = b.column(0).flatten().to_numpy(zero_copy_only=False)
            np.add.at(sums, items & (len(sums) - 1), 1)  # in place, whatever the batches
        for start in range(0, len(sums), PIECE):
            at = start + np.flatnonzero(sums[start:start + PIECE])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], schema=kinds)

    def packed(rows: pa.Table) -> pa.Table:
        slots, held = rows["slot"].to_numpy(), np.zeros(PIECE, np.int32)
        held[slots % PIECE] = np.minimum(rows["times"].to_numpy(), 2**31 - 1)
        return pa.table({"piece": pa.array(slots[:1] // PIECE, pa.int32()), "held": pa.array([held.tobytes()], pa.binary())})

    summed = in_arrow(sets.select("items"), run, "slot int, times bigint").groupBy("slot").agg(F.sum("times").alias("times"))
    pieces = summed.groupBy(F.floor(F.col("slot") / PIECE)).applyInArrow(packed, "piece int, held binary")
    out = np.zeros(1 << COUNTER_BITS, np.int32)
    for row in pieces.collect():  # 2 ** COUNTER_BITS / PIECE rows at most, no row per counter
        out[row.piece * PIECE:(row.piece + 1) * PIECE] = np.frombuffer(row.held, np.int32)
    return out


def prefixes(sets: DataFrame, times: np.ndarray, percent: int) -> DataFrame:
    """``id, component, n, item, place``: the first shingles of each set in the order (counter, shingle), without those of one set alone."""
    kinds = pa.schema([("id", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("item", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for id, component, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                x = items.values.to_numpy(zero_copy_only=False)
                c = times[x & (len(times) - 1)]
                order = np.lexsort((x, c))[:len(x) + -percent * len(x) // 100 + 1]
                place = np.flatnonzero(c[order] > 1)
                parts.append((np.full(len(place), id), np.full(len(place), component), np.full(len(place), len(x)), x[order[place]], place))
                held += len(place)
                if held >= PIECE:  # no batch grows with the texts
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(col).astype(np.int64)) for col in zip(*parts)], schema=kinds)
                    parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(col).astype(np.int64)) for col in zip(*parts)], schema=kinds)

    return in_arrow(sets.select("id", "component", "items"), run, "id bigint, component bigint, n bigint, item bigint, place bigint")


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Of sets ``id, component, items``, the pairs ``(a, b)`` of different components that a prefix filter leaves: all that are
    similar enough are among them.

    Shingles meet by component first, so that the members of a large one are never set against each other.
    """
    first = written(prefixes(sets, counters(sets), percent), "prefixes")
    several = first.groupBy("item").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    first = written(first.join(several.select("item"), "item"), "shared-prefixes")
    p = percent
    short = first.filter(F.col("place") * (100 + p) <= F.col("n") * (100 - p))  # place <= n - 2 p n / (100 + p)

    def side(t: DataFrame, mark: str) -> tuple[DataFrame, DataFrame]:
        rows = t.select("item", *[F.col(c).alias(f"{c}_{mark}") for c in ("id", "component", "n", "place")])
        sums = t.groupBy("item", F.col("component").alias(f"component_{mark}")).agg(
            F.min("n").alias(f"least_{mark}"), F.max("n").alias(f"most_{mark}"), F.max(F.col("n") - F.col("place")).alias(f"rest_{mark}"))
        return rows, sums

    (x, xs), (y, ys) = side(short, "x"), side(first, "y")
    enough = lambda rest_x, rest_y, n_x, n_y: F.least(rest_x, rest_y) * (100 + p) >= (n_x + n_y) * p
    c = F.col
    meet = xs.join(ys, "item").filter((c("component_x") != c("component_y")) & (c("least_x") <= c("most_y")) & (c("most_x") * 100 >= c("least_y") * p)
                                      & enough(c("rest_x"), c("rest_y"), c("least_x"), c("least_y")))
    meet = written(meet.select("item", "component_x", "component_y", "least_y", "most_y", "rest_y"), "meetings")
    # a member meets another component only if the bounds of that component leave room for a similar one
    some = meet.join(x, ["item", "component_x"]).filter((c("n_x") <= c("most_y")) & (c("n_x") * 100 >= c("least_y") * p)
                                                        & enough(c("n_x") - c("place_x"), c("rest_y"), c("n_x"), c("least_y")))
    found = (some.join(y, ["item", "component_y"])
             .filter((c("n_x") <= c("n_y")) & (c("n_x") * 100 >= c("n_y") * p) & enough(c("n_x") - c("place_x"), c("n_y") - c("place_y"), c("n_x"), c("n_y"))))
    return found.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
                    bins: int = BINS, rows: int = ROWS, stars: int = STARS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, n_links, text_hash``: one row per row.

    ``component_id`` is the smallest id reachable over links, ``kept`` says that the row has that id; ``n_links`` counts the
    confirmed links of the row's class; ``text_hash`` (``xxhash64`` of the text) tells rows of one id apart.
    """
    raw = as_text(text)
    texts = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.xxhash64(raw).alias("text_hash"), raw.alias("text"))
    base = written(sketches(texts, shingle, bins, rows).withColumn("row", F.monotonically_increasing_id()), "sketches")
    one = F.min(F.struct("row", "doc_id", "text_hash")).alias("one")  # names the class, and finds its text again
    classes = written(base.filter("same is not null and doc_id is not null").groupBy("same")
                      .agg(one, F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
                      .select("same", F.col("one.row").alias("class"), F.col("one.doc_id").alias("at_id"), F.col("one.text_hash").alias("at_text"), "least", "bands", "n"), "classes")
    members = classes.select(F.col("class").alias("id"), F.col("n"), F.explode("bands").alias("bucket"))
    busy = written(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    members = written(members.join(busy.select("bucket"), "bucket"), "members")
    involved = members.select("id").distinct().join(classes.select(F.col("class").alias("id"), "at_id", "at_text"), "id")
    found_again = texts.join(written(involved, "involved").hint("merge"), (F.col("doc_id") == F.col("at_id")) & (F.col("text_hash") == F.col("at_text")))
    sets = full_sets(found_again.select(F.col("id").alias("doc_id"), "text"), shingle)
    if has_repeats(base, "doc_id"):  # rows that repeat an id may be found more than once
        sets = sets.dropDuplicates(["doc_id"])
    sets = written(sets, "sets")

    close = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
    here, links, tried, labels = members.withColumn("component", F.col("id")), None, None, None
    for turn in range(stars):  # every member of an open bucket against one centre, which then leaves the bucket
        draw = F.xxhash64(F.lit(turn), F.col("id"))
        centre = F.min(F.struct(draw.alias("draw"), F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("component").alias("hub_component")))
        centres = written(here.groupBy("bucket").agg(centre.alias("centre")).select("bucket", "centre.hub", "centre.hub_n", "centre.hub_component"), "centres")
        others = written(here.join(centres, "bucket").filter("id <> hub"), "others")
        pairs = others.filter((F.col("component") != F.col("hub_component")) & close).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        found = written(confirmed(pairs, sets, percent), "links")
        tried, links = (pairs, found) if tried is None else (tried.union(pairs), links.union(found))
        labels = components(links)
        here = written(others.select("bucket", "id", "n").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "labelled")
        still = here.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
        here = written(here.join(written(still.select("bucket"), "open"), "bucket"), "open-members")

    # what the stars leave open: pairs off the centres of a bucket whose other members are of several components
    rest = written(here.select("id", "component").distinct(), "rest")
    pairs = prefix_pairs(written(rest.join(sets, rest["id"] == sets["doc_id"]).select("id", "component", "items"), "rest-sets"), percent)
    found = written(confirmed(written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs"), sets, percent), "links")
    if found.limit(1).count():
        links = links.union(found)
        labels = components(links)
    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    known = written(labels.join(degree, "id").join(classes.select(F.col("class").alias("id"), "least"), "id"), "known")
    smallest = written(known.groupBy("component").agg(F.min("least").alias("smallest")), "smallest")
    known = written(known.join(smallest, "component").select("id", "smallest", "n_links"), "known")
    named = classes.select("same", "class", "least").join(known, F.col("class") == F.col("id"), "left").select("same", F.coalesce("smallest", "least").alias("component"), "n_links")
    out = base.select("doc_id", "text_hash", "n_shingles", "same").join(named, "same", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
                      F.coalesce("n_links", F.lit(0)).alias("n_links"), "text_hash")
