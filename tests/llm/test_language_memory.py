"""What a task of the language identification holds at once: decoded rows, dictionaries of the table it writes."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strideframe.llm import language, shared

DECODED = "spark.sql.parquet.columnarReaderBatchSize"


@pytest.fixture
def identified(spark, tmp_path, monkeypatch):
    """Runs the operator over a Parquet table; returns its rows and, of every table it writes, the name, rows decoded at once and path."""
    words = {"aa": "lorem ipsum dolor sit amet", "bb": "quick brown foxes jumping over"}
    rows = [(i, f"{words[x]} {'xyz'[i % 3] * (i % 7 + 1)}", x, f"{x}.org") for i in range(300) for x in [("aa", "bb")[i % 2]]]
    spark.createDataFrame(rows, "id long, text string, lang string, host string").write.parquet(f"{tmp_path}/docs")
    seen, path = [], shared.new_path

    def new_path(session, name):
        at = path(session, name)
        seen.append((name, session.conf.get(DECODED, None), at))
        return at

    monkeypatch.setattr(shared, "new_path", new_path)

    def run():
        docs = spark.read.parquet(f"{tmp_path}/docs")
        out = language.identify(docs, language.train(docs), F.col("text"), host=F.col("host"), carry=["id"])
        return sorted((r.id, r.language, r.kept) for r in out.collect()), list(seen)

    return run, [(i, x, True) for i, _, x, _ in rows]


def test_few_rows_are_decoded_at_once(spark, identified):
    run, expected = identified
    got, tables = run()
    assert got == expected
    assert {"trigrams", "likelihoods", "hosts"} <= {name for name, _, _ in tables}
    assert {rows for _, rows, _ in tables} == {"128"}
    assert spark.conf.get(DECODED, None) is None  # the session's own is back


def test_a_limit_that_is_set_stays(spark, identified):
    run, expected = identified
    spark.conf.set(DECODED, "7")
    try:
        got, tables = run()
        assert got == expected and {rows for _, rows, _ in tables} == {"7"}
        assert spark.conf.get(DECODED) == "7"
    finally:
        spark.conf.unset(DECODED)


def test_the_limit_goes_when_a_call_fails(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 1)
    docs = spark.createDataFrame([("x y z", "aa"), ("z y x", "bb")], "text string, lang string")
    with pytest.raises(ValueError):
        language.train(docs)
    assert spark.conf.get(DECODED, None) is None


def test_likelihoods_are_written_without_dictionaries(identified):
    _, tables = identified[0]()
    folder = next(path for name, _, path in tables if name == "likelihoods").removeprefix("file:")
    encodings = set()
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            meta = pq.ParquetFile(f"{folder}/{name}").metadata
            encodings |= {e for g in range(meta.num_row_groups) for c in range(meta.num_columns) for e in meta.row_group(g).column(c).encodings}
    assert encodings and not any("DICTIONARY" in e for e in encodings)
