"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing to target weights, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; the stages' results are written as
Parquet in the cluster's shared folder and read again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import language, mixing, nearcopies, packing, radix
from strideframe.llm.queries import query, tokenizer_files
from strideframe.llm.shared import SPACE, as_text, written

ORACLE_SQL = None  # trained and hashed stages; tests compare them with brute force


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; the label column serves to fit the text models, not as evidence.

    A null text has no evidence but its host; documents judged to be of no known language go, repeated rows alike."""
    judged = language.identify(docs, language.train(docs), F.col("text"), host=F.col("source"))
    return judged.filter("kept").select(*docs.columns)


def staying(docs: DataFrame, verdicts: DataFrame, own: Column) -> DataFrame:
    """The documents that a dedup operator keeps, and all rows without id.

    A verdict belongs to the rows of its id and of its text's digest ``own``, so an id may repeat with different texts.  Of the
    rows of one id and digest the longest text stays, once.
    """
    keys = ["doc_id", "own_digest"]
    kept = verdicts.filter("kept").select(*keys).distinct()
    met = docs.withColumn("own_digest", own).join(kept.hint("merge"), keys, "left_semi")
    longest = F.max_by(F.struct(*docs.columns), F.struct(F.length("text"), "text")).alias("row")
    return met.groupBy(*keys).agg(longest).select("row.*").union(docs.filter("doc_id is null"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; rows without id stay, null texts count as empty, no rows give no rows."""
    verdicts = radix.exact_duplicates(docs).withColumnRenamed("text_sha256", "own_digest")
    return staying(docs, verdicts, F.sha2(F.regexp_replace(as_text("text"), f"{SPACE}+", ""), 256))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; texts without words and rows without id stay, no rows give no rows."""
    verdicts = nearcopies.near_duplicates(docs).withColumnRenamed("text_hash", "own_digest")
    return staying(docs, verdicts, F.xxhash64(as_text("text")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per whole copy and per word range that the mix takes; texts without words are not in it, no rows give no rows."""
    return mixing.mixed_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece; a null text has the end id alone, repeated rows are packed each."""
    return packing.pack(docs, *tokenizer_files())


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("MinHash near-dedup", near_dedup),
          ("mixing sources to target weights", mix_sources), ("packing", pack)]


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
