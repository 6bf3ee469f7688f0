"""Helpers of the training-data operators: written intermediate tables, word patterns, connected components."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the space and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
#: What a task hands to Python at once.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: What a task decodes of a Parquet file at once.
DECODED, DECODED_ROWS = "spark.sql.parquet.columnarReaderBatchSize", 128


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.  A local master without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="strideframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has written to."""
    return f"{shared_folder(spark)}/{name}-{os.urandom(8).hex()}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, under the writer's ``options``, and read it again.

    Cuts the lineage (a lost executor costs no recomputation), and tells the planner the table's real size.
    """
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def decoding_few(run: Callable) -> Callable:
    """``run(rows, ...)``, with Parquet files decoded ``DECODED_ROWS`` rows at once in the tables that it writes or collects.

    Every task keeps the decoded rows of a column in one array, which doubles as it grows: by default 4,096 texts, tens of MB in the
    JVM's heap for each of them.  A limit that is set already stays; the session's own is back when ``run`` ends.
    """

    @wraps(run)
    def limited(rows: DataFrame, *args, **kwargs):
        conf = rows.sparkSession.conf
        if conf.get(DECODED, None) is not None:
            return run(rows, *args, **kwargs)
        conf.set(DECODED, str(DECODED_ROWS))
        try:
            return run(rows, *args, **kwargs)
        finally:
            conf.unset(DECODED)

    return limited


def in_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of some ``BATCH_BYTES``.

    Every task holds a batch in the JVM, outside its heap and with room to double, and once more in Python; by default that is 64 MB of
    texts.  The limit is set for the session, since tables are computed later; one that is set already stays.
    """
    if df.sparkSession.conf.get(BATCH, None) is None:
        df.sparkSession.conf.set(BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def as_text(text: str | Column) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words.  Each word with the space behind it becomes one character, then the characters are counted."""
    bare = F.regexp_replace(text, rf"^{SPACE}+", "")
    return F.length(F.regexp_replace(bare, rf"{WORD}{SPACE}*", "x")).cast("bigint")


def has_repeats(df: DataFrame, id: str) -> bool:
    """Whether rows repeat an id.  Only the ids move."""
    return df.filter(F.col(id).isNotNull()).groupBy(id).count().filter("count > 1").limit(1).count() > 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table: ``(id, component)``, component being the smallest id reachable.

    Only ids that occur in an edge are returned.  Labels spread over edges and are shortcut through the label of the
    label, so the rounds grow with the logarithm of the diameter.  Each round is written to the shared folder; only one
    count per round reaches the driver.
    """
    both = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
                   .union(edges.select(F.col(b), F.col(a))).filter("u <> v").distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        spread = (both.join(labels.select(F.col("u").alias("v"), "label"), "v")
                  .groupBy("u").agg(F.min("label").alias("near")))
        hop = labels.select(F.col("u").alias("label"), F.col("label").alias("far"))
        new = written(labels.join(hop, "label").join(spread, "u")
                      .select("u", F.least("label", "far", "near").alias("label"),
                              (F.least("far", "near") < F.col("label")).alias("changed")), "labels")
        labels = new.select("u", "label")
        if new.filter("changed").limit(1).count() == 0:
            return labels.select(F.col("u").alias("id"), F.col("label").alias("component"))
