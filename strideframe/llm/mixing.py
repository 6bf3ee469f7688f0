"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.  DataFrame functions only.

1. Words are counted per document, and summed per source.
2. Targets: a share of all words is split by weight; a source stops at ``cap`` times its own size, and what it leaves is
   split among the others by weight, until no source is above (water filling, in closed form over sorted ratios).
3. Seats (blocks of ``block`` words) go to sources by the highest quotients ``target / (2k - 1)``.
4. A source's documents are dealt into shards by a seeded hash, and its seats to its shards by the same apportionment.
5. A shard's documents stand in a seeded order and are cut into blocks.  A quota of whole rounds plus a rest takes every
   block that often, and the rest as consecutive blocks from a seeded start.

The text is read once; everything after moves (id, source, size).  A source with any share of the rows is split into shards
of some ``shard`` words, 4,096 at most, so no window holds a whole source.  Source and shard tables have one row per source
or shard and are written, so that the planner broadcasts them only where their measured size allows.

Defined results: a null text has size 0; a null source is a source of its own, the last; rows without words take 0 words;
repeated rows are mixed as rows of their own; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.shared import SPACE, WORD, as_text, has_repeats, word_count, written

SEED, SHARES, WEIGHTS, CAP = "mix-1", 1.5, (3, 1, 2), 2
BLOCK, SHARD, MOST_SHARDS = 16, 65536, 4096


def apportion(table: DataFrame, group: list[str], key: str, weight: str, seats: Column) -> DataFrame:
    """Adds ``quota``: the seats of each row when ``seats`` (the same in all rows of a group) are given one by one to the
    highest quotient ``weight / (2k - 1)``, ties to the smaller ``key``.

    Rounding each exact share is the answer for a slightly different number of seats.  From there only the missing (or
    surplus) seats are ranked: about 3.5 candidate quotients per row instead of one per seat.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    share = F.when(F.sum(weight).over(w) > 0, F.col(weight) / F.sum(weight).over(w)).otherwise(0.0)
    t = table.withColumn("_seats", seats.cast("bigint")).withColumn("_share", share)
    t = t.withColumn("_base", F.floor(F.col("_seats") * F.col("_share") + 0.5).cast("bigint"))
    t = (t.withColumn("_diff", F.when(F.sum(weight).over(w) > 0, F.col("_seats") - F.sum("_base").over(w)).otherwise(F.lit(0)))
         .withColumn("_n", F.count(F.lit(1)).over(w)))
    tries = (F.ceil((F.abs("_diff") + F.col("_n")) * F.col("_share")) + 1).cast("int")
    up = F.col("_diff") > 0
    t = t.withColumn("_try", F.explode(F.sequence(F.lit(1), tries)))
    seat = F.when(up, F.col("_base") + F.col("_try")).otherwise(F.col("_base") - F.col("_try") + 1)
    quotient = F.when(seat >= 1, F.col(weight) / (2 * seat - 1))
    order = [F.when(up, -quotient).otherwise(quotient).asc_nulls_last(), F.when(up, F.col(key)).asc(), F.when(~up, F.col(key)).desc()]
    place = F.row_number().over((Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(*order))
    t = t.withColumn("_taken", (quotient.isNotNull() & (place <= F.abs("_diff"))).cast("int"))
    cols = [F.col(c) for c in table.columns]
    return (t.groupBy(*cols, "_base", "_diff").agg(F.sum("_taken").alias("_moved"))
            .select(*cols, (F.col("_base") + F.signum("_diff").cast("bigint") * F.col("_moved")).alias("quota")))


def targets(sizes: DataFrame, shares: float = SHARES, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``source, sid, source_size, target`` from ``(source, size)``.  One row per source; windows over those rows only."""
    whole = Window.partitionBy(F.lit(0))
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = t.withColumn("sid", F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())))
    t = t.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("_cap", F.col("source_size") * F.lit(cap)).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = whole.orderBy("_ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * F.lit(shares) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    open_weight = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    t = t.withColumn("_level", left / open_weight)
    t = t.withColumn("_level", F.max("_level").over(whole))
    target = F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w"))
    return t.select("source", "sid", "source_size", target.alias("target"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", shares: float = SHARES,
        weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, shard: int = SHARD, seed: str = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken, rounds, spans``: ``taken`` words of the document are in the mix, namely
    ``rounds`` whole copies and the word ranges ``spans`` (array<struct<from, to>>, at most two).
    """
    named = F.coalesce(F.col(id).cast("string"), F.concat(F.lit("?"), F.md5(as_text(text))))  # rows without id draw by their texts
    draw = F.md5(F.concat_ws("|", F.lit(seed), named))
    sizes = written(docs.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), word_count(as_text(text)).alias("size"), draw.alias("draw")), "sizes")
    src = targets(sizes, shares, weights, cap)
    whole = Window.partitionBy(F.lit(0))
    src = apportion(src, [], "sid", "target", F.floor(F.sum("target").over(whole) / block + 0.5))
    n_shards = F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.ceil(F.col("source_size") / shard))).cast("int")
    src = written(src.withColumn("n_shards", n_shards), "sources")

    number = lambda h, at: F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")
    d = sizes.join(src, sizes["source"].eqNullSafe(src["source"])).drop(sizes["source"], src["source"])
    d = d.withColumn("shard", number(F.col("draw"), 1) % F.col("n_shards"))

    shards = d.groupBy("sid", "shard", F.col("quota").alias("seats")).agg(F.sum("size").alias("words"))
    shards = apportion(shards, ["sid"], "shard", "words", F.col("seats"))
    blocks = F.ceil(F.col("words") / block)
    shards = shards.withColumn("blocks", blocks).withColumn("quota", F.least(F.col("quota"), cap * F.col("blocks")))
    start = number(F.md5(F.concat_ws("|", F.lit(seed), "sid", "shard")), 1)
    some = F.col("blocks") > 0
    shards = written(shards.select(
        "sid", "shard", F.when(some, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).cast("bigint").alias("rounds"),
        F.when(some, start % F.col("blocks") * block).otherwise(0).alias("from"),
        F.when(some, F.col("quota") % F.col("blocks") * block).otherwise(0).alias("extra"),
        (F.col("blocks") * block).alias("around")), "shards")

    order = Window.partitionBy("sid", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0))).join(shards, ["sid", "shard"])
    end = F.col("at") + F.col("size")

    def part(lo: Column, hi: Column) -> Column:
        return F.struct((F.greatest(lo, F.col("at")) - F.col("at")).alias("from"), (F.least(hi, end) - F.col("at")).alias("to"))

    last = F.col("from") + F.col("extra")
    spans = F.array(part(F.lit(0), last - F.col("around")), part(F.col("from"), last))
    d = d.withColumn("spans", F.filter(spans, lambda s: s["to"] > s["from"]))
    extra = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["to"] - s["from"])
    return d.select("doc_id", "size", "source_size", "target", (F.col("rounds") * F.col("size") + extra).alias("taken"), "rounds", "spans")


def mixed_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", chars: str = "n_chars", **options) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: one row per whole copy, and one per word range, its text cut.

    ``chars`` is counted again where there is such a column.  Where ids repeat, rows are told apart by text and source, and rows equal
    in these are one document; rows without id are named by a digest of their text.
    """
    key = F.coalesce(F.col(id).cast("string"), F.concat(F.lit("?"), F.md5(as_text(text))))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"), F.col(text).alias("text"), F.col(source).alias("source"))
    if has_repeats(rows, "key"):
        own = F.md5(F.concat(as_text("text"), F.coalesce(F.concat(F.lit("|"), F.col("source").cast("string")), F.lit(""))))
        rows = rows.withColumn("key", F.concat_ws("|", "key", own)).dropDuplicates(["key"])
    plan = mix(rows, "key", **options).filter("taken > 0")
    copies = F.array_repeat(F.struct(F.lit(0).cast("bigint").alias("from"), F.col("size").alias("to")), F.col("rounds").cast("int"))
    parts = plan.select(F.col("doc_id").alias("key"), "size", F.explode(F.concat(copies, "spans")).alias("part"))
    d = rows.join(parts.hint("merge"), "key")
    words = F.filter(F.split("text", rf"(?<={SPACE})(?={WORD})"), lambda w: F.regexp_like(w, F.lit(WORD)))  # each with the space behind it
    cut = F.array_join(F.slice(words, (F.col("part.from") + 1).cast("int"), (F.col("part.to") - F.col("part.from")).cast("int")), "")
    d = d.withColumn("text", F.when((F.col("part.from") == 0) & (F.col("part.to") == F.col("size")), F.col("text")).otherwise(cut))
    new = {text: F.col("text"), chars: F.length("text").cast("bigint")}
    return d.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
