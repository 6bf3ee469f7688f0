"""Nearest-neighbour mutual information against its plain definition."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe.models.selection import nearest_information, two_stage_elimination
from strideframe.operators.neighbours import digamma, neighbour_information


def psi(m):
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(m)))


def plain(a, b, k=3):
    steps = [np.floor((v - v.mean()) / (v.std() if np.ptp(v) else 1.0) * 2.0 ** 32 + 0.5).astype(np.int64) for v in (a, b)]
    da, db = (np.abs(v[:, None] - v) for v in steps)
    r = np.sort(np.maximum(da, db), axis=1)[:, k]  # the row itself comes first
    counts = [((d < r[:, None]) | (d == 0)).sum(1) for d in (da, db)]
    return max(0.0, psi(len(a)) + psi(k) - np.mean([psi(x) + psi(y) for x, y in zip(*counts)]))


@pytest.fixture(scope="module")
def columns():
    rng = np.random.default_rng(5)
    n = 2000
    x = rng.normal(size=n)
    hot = np.where(rng.random(n) < 0.34, 1.0, rng.exponential(size=n))  # a third of the rows hold one value
    y = x + 0.3 * rng.normal(size=n)
    y[rng.random(n) < 0.34] = 0.25
    return {"close": (x, y), "ties": (np.round(x, 1), np.round(y, 1)), "hot": (hot, y), "free": (rng.normal(size=n), y),
            "flat": (np.full(n, 0.1), y), "tail": (np.exp(3 * x), y)}


@pytest.mark.parametrize("cell", [64, 1024])
def test_equals_the_definition(spark, columns, cell):
    pdf = pd.concat([pd.DataFrame({"f": name, "u": a, "v": b}) for name, (a, b) in columns.items()])
    got = neighbour_information(spark.createDataFrame(pdf), "f", "u", "v", 3, cell).toPandas().set_index("f")
    for name, (a, b) in columns.items():
        assert got.loc[name, "n"] == len(a)
        assert got.loc[name, "mi"] == pytest.approx(plain(a, b), abs=1e-8), name
    assert got.loc["close", "mi"] > 0.3 > got.loc["free", "mi"]


def test_missing_values_few_rows_and_empty_tables(spark):
    rows = [("few", 1.0, 2.0), ("few", 2.0, 1.0), ("few", None, 1.0), ("few", 3.0, math.nan), ("few", math.inf, 1.0), (None, 1.0, 1.0),
            *[("same", 1.0, 1.0)] * 5, *[("line", float(i), float(i)) for i in range(6)], ("line", 9.0, None)]
    df = spark.createDataFrame(rows, "f string, u double, v double")
    got = {r.f: (r.n, r.mi) for r in neighbour_information(df, "f", "u", "v").collect()}
    line = np.arange(6.0)
    assert got["few"] == (2, None)
    assert got["same"] == (5, 0.0)
    assert got["line"] == (6, pytest.approx(plain(line, line), abs=1e-9)) and len(got) == 3
    assert neighbour_information(df.limit(0), "f", "u", "v").collect() == []
    with pytest.raises(ValueError):
        neighbour_information(df, "f", "u", "v", k=0)


def test_digamma(spark):
    got = spark.range(1, 200).select("id", digamma(F.col("id"))).collect()
    assert all(r[1] == pytest.approx(psi(r[0]), abs=1e-9) for r in got)


def test_first_stage_by_neighbours(spark, columns):
    x, y = columns["close"]
    pdf = pd.DataFrame({"good": x, "noise": columns["free"][0], "flat": 1.0, "ttf": y})
    df = spark.createDataFrame(pdf)
    ranks = {r.feature: r.mi for r in nearest_information(df, ["good", "noise", "flat"], "ttf").collect()}
    assert ranks["good"] == max(ranks.values())
    assert two_stage_elimination(df, "ttf", 34, 1, neighbours=3).columns == ["good"]
