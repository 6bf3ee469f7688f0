"""The corpus pipeline, stage by stage, on a small corpus with planted copies."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from strideframe.llm import mixing, nearcopies, packing, queries, shared

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    parts = {"aa": ["ba", "ko", "ti", "ra"], "bb": ["sch", "ung", "ei", "str"]}
    rows = []
    for i in range(120):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(4)) for _ in range(rng.choice([20, 60, 200]))), lang, f"s{i % 5}"))
    rows += [(200 + i, rows[i][1] + ("  " if i % 2 else ""), rows[i][2], "s1") for i in range(10)]  # exact copies
    near = rows[20][1].split(" ")
    rows += [(300 + i, " ".join([*near[:-1], f"t{i}"]), rows[20][2], "s2") for i in range(5)]
    rows += [(400, "⁂※ " * 90, None, "s0"), (401, None, None, None), (402, "", "bb", None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs = first = spark.read.parquet(f"{folder}/documents.parquet")
    left = []
    for _, stage in pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder)
        assert docs.columns == first.columns
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    judged, exact, near = left
    assert 400 not in judged and set(range(120)) <= judged
    assert all(len({i, 200 + i} & exact) == 1 for i in range(10)) and set(range(10, 120)) <= exact  # the longer one stays
    assert len(near & {20, *range(300, 305)}) == 1 and exact - near <= {20, *range(300, 305)}
    mixed = pipeline.mix_sources(spark, docs.cache(), folder)
    assert mixed.columns == first.columns
    plan = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    words = collections.Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == {i: n for i, n in plan.items() if n}
    packed = pipeline.pack(spark, mixed, folder)
    encode = packing.encoder(*queries.tokenizer_files())
    assert packed.agg(F.sum("length")).first()[0] == sum(len(encode(r.text)) + 1 for r in mixed.collect())


def test_run(spark, folder):
    assert pipeline.run(spark, folder).count() > 0
    assert queries.QUERIES["pipeline"] is pipeline.run


def test_stages_without_rows(spark, folder):
    docs = empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
    assert docs.columns == empty.columns


def test_repeated_and_nameless_rows_stay(spark, folder):
    text = "ba ko ti ra bako tira koba rati bakoti rakoba tirako batira"
    docs = spark.createDataFrame([(1, text, "aa", "s", 5), (1, text, "aa", "s", 5), (None, text + " koko", "aa", None, 5)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for stage in (pipeline.exact_dedup, pipeline.near_dedup):
        assert sorted(r.doc_id or 0 for r in stage(spark, docs, folder).collect()) == [0, 1]


def test_repeated_ids_lose_no_text(spark, folder):
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(1, "aaaa", "aa", "s", 4), (1, "bbbb", "aa", "s", 4), (5, "a aaa", "aa", "s", 5), (6, "bbbb", "aa", "s", 4)], columns)
    assert sorted(r.text for r in pipeline.exact_dedup(spark, docs, folder).collect()) == ["a aaa", "bbbb"]
    assert sorted(r.text for r in pipeline.near_dedup(spark, docs, folder).collect()) == ["a aaa", "aaaa", "bbbb"]
    long = [" ".join(f"{c}{i}" for i in range(300)) for c in "ab"]
    twice = spark.createDataFrame([(1, long[0], "aa", "s", 4), (1, long[1], "aa", "s", 4), (None, long[0], "aa", "s", 4), (None, long[1], "aa", "s", 4)], columns)
    mixed = collections.Counter((r.doc_id, r.text) for r in pipeline.mix_sources(spark, twice, folder).collect())
    assert all(mixed[key, text] >= 1 for key in (1, None) for text in long)  # 150 %: a whole copy each, and ranges
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:-1] + ["end"]), "something else altogether, with no word in common at all"]
    docs = spark.createDataFrame([(7, texts[2], "aa", "s", 1), (7, texts[0], "aa", "s", 1), (3, texts[1], "aa", "s", 1)], columns)
    assert sorted(r.text for r in pipeline.near_dedup(spark, docs, folder).collect()) == sorted([texts[1], texts[2]])


def test_every_operator_is_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES if n != "pipeline")
    assert numbers == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_batches_of_texts_are_bounded(spark):
    """A task hands Python some 4 MB at once, not 64 MB: the JVM holds it outside its heap, and Python again."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "n"])

    spark.conf.unset(shared.BATCH)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 1000).alias("text"))
    nearcopies.full_sets(docs, 5)  # the operators set it
    assert int(spark.conf.get(shared.BATCH).rstrip("b")) == shared.BATCH_BYTES
    got = shared.in_arrow(docs, sizes, "size bigint, n bigint").agg(F.max("size").alias("size"), F.sum("n").alias("n")).first()
    assert got["size"] < 2 * shared.BATCH_BYTES and got["n"] == 3000
    spark.conf.set(shared.BATCH, str(1 << 20))  # what is set stays
    nearcopies.full_sets(docs, 5)
    assert spark.conf.get(shared.BATCH).rstrip("b") == str(1 << 20)
    spark.conf.unset(shared.BATCH)


def test_counters_over_several_batches(spark):
    spark.conf.set(shared.BATCH, "1000")
    try:
        sets = spark.range(0, 400, 1, 2).selectExpr("id as doc_id", "transform(sequence(0, 40), i -> (id % 7) * i * 104729 - 5) as items")
        got = nearcopies.counters(sets)
    finally:
        spark.conf.unset(shared.BATCH)
    want = np.zeros(len(got), np.int64)
    for i in range(400):
        np.add.at(want, np.array([(i % 7) * k * 104729 - 5 for k in range(41)]) & (len(want) - 1), 1)
    assert (got == want).all()


def test_counters_reach_the_driver_in_pieces(spark, monkeypatch):
    """No row per counter: a million of them took the driver's memory."""
    kind, met = type(spark.range(0)), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: met.append(collect(self)) or met[-1])
    sets = spark.range(0, 2000, 1, 2).selectExpr("id as doc_id", "transform(sequence(0, 9), i -> xxhash64(id div 2, i)) as items")
    got, items = nearcopies.counters(sets), np.array([r["items"] for r in collect(sets)]).ravel()
    assert (got == np.bincount(items & (len(got) - 1), minlength=len(got))).all()
    assert sum(map(len, met)) <= len(got) // nearcopies.PIECE
    assert not nearcopies.counters(sets.limit(0)).any()
