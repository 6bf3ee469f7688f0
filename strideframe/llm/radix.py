"""Exact deduplication by distributed MSD radix partitioning: groups are split by successive bytes until they are singletons
or have ended.  Equality is equality of bytes; no digest decides it.

The first digit is the number of bytes and the first ``HEAD`` bytes, the next ones are strings of bytes that grow from level
to level (and with them the depth, so that the number of levels grows with the logarithm of the longest text, up to digits
of ``WIDEST`` bytes).  Per level the members of each (group, digit) are counted with partial aggregation, so a digit that a
third of all rows share costs one row per task; groups of one leave, groups that have ended leave, only the rest goes on.
The count tables and what is left are written per level; a row meets its group in a join whose skewed side can be split.

Defined results: a null text counts as empty, and empty texts are equal to each other; a row without id is never compared:
it is a group of its own and stays; rows that repeat an id count as members of their own, and of a group all rows with
the id that stays are marked as kept (groups are named by length and digits, never by ids); extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.shared import SPACE, as_text, written

HEAD, FIRST, GROWTH, WIDEST = 32, 256, 8, 131072


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", head: int = HEAD, first: int = FIRST,
                     growth: int = GROWTH, widest: int = WIDEST) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per row.

    Texts are equal when they are so without white space.  Of a group the row with the most code points in its original
    text stays, then the smallest id.
    """
    raw = as_text(text)
    bare = F.regexp_replace(raw, f"{SPACE}+", "")
    rows = docs.select(F.col(id).alias("doc_id"), F.length(raw).alias("points"), bare.alias("bare"))
    rows = rows.select("doc_id", "points", "bare", F.octet_length("bare").alias("n"),
                       F.substring(F.col("bare").cast("binary"), 1, head).alias("digit"))

    groups = written(rows.filter("doc_id is not null").groupBy("n", "digit")
                     .agg(F.count(F.lit(1)).alias("members")).filter("members > 1").withColumn("group", F.monotonically_increasing_id()), "radix-groups")
    longest = groups.agg(F.max("n")).first()[0] or 0  # one number
    met = rows.join(groups.drop("members").hint("merge"), ["n", "digit"], "left")  # at any size: the rows' side can be split
    alive = F.col("group").isNotNull() & F.col("doc_id").isNotNull()
    level = written(met.select("doc_id", "points", "n", F.when(alive, F.col("group")).alias("group"), F.sha2("bare", 256).alias("text_sha256"),
                               F.when(alive & (F.col("n") > head), F.col("bare").cast("binary")).alias("bare")), "radix-level")

    done, at, width = [], head, first
    while True:
        done.append(level.filter(F.col("group").isNull() | (F.col("n") <= at)).drop("bare"))
        if at >= longest:
            break
        level = level.filter(F.col("group").isNotNull() & (F.col("n") > at)).withColumn("digit", F.substring("bare", at + 1, width))
        groups = written(level.groupBy("group", "digit").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members")
                         .withColumn("to", F.monotonically_increasing_id()), "radix-groups")
        level = written(level.join(groups, ["group", "digit"], "left")
                        .select("doc_id", "points", "n", F.col("to").alias("group"), "text_sha256", F.when(F.col("to").isNotNull(), F.col("bare")).alias("bare")), "radix-level")
        at, width = at + width, min(width * growth, widest)

    ended = reduce(DataFrame.union, done)
    stays = written(ended.filter("group is not null").groupBy("n", "group")  # a group's number is unique among those of its length
                    .agg(F.max(F.struct("points", (-F.col("doc_id")).alias("id"))).alias("best"), F.count(F.lit(1)).alias("members"))
                    .select("n", "group", (-F.col("best.id")).alias("keep"), "members"), "radix-stays")
    keep = F.coalesce("keep", "doc_id")
    return ended.join(stays, ["n", "group"], "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("members", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, F.lit(True)).alias("kept"), "text_sha256")
