import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe.functions.bins import digitize, histogram
from strideframe.functions.columns import list_statistics, transpose_lists
from strideframe.functions.slices import three_slices
from strideframe.operators.cycles import combine_cycles, cycle_boundaries, split_cycles
from strideframe.operators import matching
from strideframe.operators.matching import best_match, cross_correlation, information_of_shifts, shifts_are_cheaper, template_information
from strideframe.operators.resample import resample
from strideframe.series import contract_violations, dense_positions, series
from strideframe.sources import readers, writers

SCHEMA = "series_id string, pos bigint, x double, ttf double"


def test_dense_positions_with_a_hot_key(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 'rare' || id % 7, 'hot') as k", "id * 37 % 5003 as t")
    got = dense_positions(df, ["k"], "t").toPandas()
    for _, g in got.groupby("k"):
        assert list(g.sort_values("t").pos) == list(range(len(g)))


def test_contract(spark):
    s = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0), ("b", 0, 1.0), ("b", 2, 1.0), ("c", 0, 1.0), ("c", 0, 1.0), ("c", 2, 1.0)],
                              "series_id string, pos bigint, x double")
    assert {r.series_id for r in contract_violations(s).collect()} == {"b", "c"}


def zeros(x, threshold, gap):
    idx = np.where(x < threshold)[0]
    return [0] + [idx[i - 1] for i in range(1, len(idx)) if idx[i] - idx[i - 1] > gap] + [idx[-1]]


@pytest.mark.parametrize("gap", [3, 10, 50])
def test_cycles(spark, gap):
    rng = np.random.default_rng(gap)
    ttf = rng.uniform(0, 1, 800)
    pdf = pd.DataFrame({"series_id": "a", "pos": np.arange(800), "x": np.arange(800.0), "ttf": ttf})
    s = spark.createDataFrame(pdf, SCHEMA).repartition(4)
    want = zeros(ttf, 0.1, gap)
    assert sorted(r.boundary for r in cycle_boundaries(s, 0.1, gap).collect()) == want
    got = split_cycles(s, 0.1, gap).toPandas().sort_values("pos")
    pieces = [list(range(a, b)) for a, b in zip(want, want[1:])]
    assert [list(g.pos) for _, g in got.groupby("cycle_id")] == [p for p in pieces if p]
    kept = combine_cycles(split_cycles(s, 0.1, gap), [2]).toPandas().sort_values("pos")
    assert list(kept.x) == [float(i) for k, p in enumerate(pieces) if k != 1 for i in p] and list(kept.pos) == list(range(len(kept)))
    with pytest.raises(Exception, match="no label below"):
        cycle_boundaries(s, -1.0, gap).collect()


def test_resample(spark):
    df = spark.createDataFrame([("a", 0, 10.0), ("a", 1, 20.0), ("a", 2, 40.0), ("b", 0, 5.0)], "series_id string, win bigint, v double")
    got = resample(df, ["v"], 5).orderBy("series_id", "win").toPandas()
    assert list(got.v) == [10, 15, 20, 30, 40, 5, 5, 5, 5, 5]
    x = np.random.default_rng(1).normal(size=37)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "series_id string, win bigint, v double")
    for m in (1, 2, 36, 37, 38, 90):
        got = resample(df, ["v"], m).orderBy("win").toPandas().v
        np.testing.assert_allclose(got, np.interp(np.linspace(0, 36, m), np.arange(37), x), atol=1e-12)


def test_digitize_and_histogram_match_numpy(spark):
    x = np.round(np.random.default_rng(2).uniform(-2, 14, 3000), 1)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for low, step, edges in ((0.0, 1.0, 16), (0.0, 0.1, 100), (-1.5, 0.3, 20)):
        grid = np.arange(edges) * step + low
        got = df.select("x", digitize(F.col("x"), low, step, edges).alias("y")).toPandas()
        assert (got.y == np.digitize(got.x, grid)).all()
    got = histogram(df, "x", 0.0, 1.0, 12).orderBy("bin").toPandas()
    assert list(got["count"]) == list(np.histogram(x, np.arange(13))[0])


def test_list_columns(spark):
    df = spark.createDataFrame([(1, [1.0, None, 3.0]), (2, [4.0]), (3, [2.0, 2.0, 2.0])], "id int, m array<double>")
    got = list_statistics(df, "m").orderBy("id").toPandas()
    want = np.array([[1, 0, 3], [4, 0, 0], [2, 2, 2]], float)
    np.testing.assert_allclose(got[["m_mean", "m_min", "m_max", "m_std"]].values,
                               np.c_[want.mean(1), want.min(1), want.max(1), want.std(1, ddof=1)])
    assert [list(r["values"]) for r in transpose_lists(df, "m", "id").orderBy("position").collect()] == want.T.tolist()


def test_three_slices(spark):
    s = spark.range(11).selectExpr("'a' as series_id", "id as pos", "double(id) as x")
    got = three_slices(s, 4).toPandas().groupby("part").pos.apply(sorted).to_dict()
    assert got == {"first": [0, 1, 2, 3], "middle": [3, 4, 5, 6], "last": [7, 8, 9, 10]}


@pytest.mark.parametrize("block", [1, None])
def test_cross_correlation(spark, block):
    rng = np.random.default_rng(3)
    x = rng.normal(size=900)
    t = x[333:373].copy()
    s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "series_id string, pos bigint, x double").repartition(3)
    corr = cross_correlation(s, t, block)
    got = corr.orderBy("pos").toPandas()
    np.testing.assert_allclose(got["corr"], np.correlate(x, t, "valid"), atol=1e-9)
    assert best_match(corr).first().pos == np.correlate(x, t, "valid").argmax()
    parts = cross_correlation(s, t, block, part=16).orderBy("pos").toPandas()  # a template in several parts
    np.testing.assert_allclose(parts["corr"], got["corr"], atol=1e-9)


def test_template_information_window_starts(spark):
    s = spark.range(100).selectExpr("'a' as series_id", "id as pos", "double(id % 5) as x")
    got = template_information(s, s.filter("pos < 20"), 20, 10, 0.0, 10.0, 1.0).orderBy("win").toPandas()
    assert list(got.win) == list(range(len(range(0, 100 - 20, 10)))) and np.allclose(got.nmi, 1)


def test_text_sources(spark, tmp_path):
    rng = np.random.default_rng(4)
    want = {}
    for k in range(3):
        want[f"seg_{k:02d}"] = v = rng.integers(-300, 300, 4000 + 13 * k)
        pd.DataFrame({"acoustic_data": v}).to_csv(tmp_path / f"seg_{k:02d}.csv", index=False)
    (tmp_path / "notes.txt").write_text("not a segment")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # several splits per file
    try:
        got = readers.read_segments(spark, str(tmp_path)).toPandas().sort_values(["series_id", "pos"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {k: list(g.x.astype(int)) for k, g in got.groupby("series_id")} == {k: list(v) for k, v in want.items()}
    assert all(list(g.pos) == list(range(len(g))) for _, g in got.groupby("series_id"))
    assert readers.find_files(spark, str(tmp_path), "*.csv").count() == 3

    pd.DataFrame({"acoustic_data": [200, -300, 7], "time_to_failure": [1.5, 1.25, 1.0]}).to_csv(tmp_path / "train.csv", index=False)
    train = readers.read_training_csv(spark, str(tmp_path / "train.csv")).orderBy("pos").toPandas()
    assert list(train.x) == [200, -300, 7] and list(train.ttf) == [1.5, 1.25, 1.0] and list(train.pos) == [0, 1, 2]
    writers.convert_signal(spark, str(tmp_path / "train.csv"), str(tmp_path / "train.parquet"))
    assert readers.read_by_extension(spark, str(tmp_path / "train.parquet")).columns == ["s", "ttf"]
    with pytest.raises(ValueError):
        readers.read_by_extension(spark, "x.h5")


def test_sinks(spark, tmp_path):
    runs = spark.createDataFrame([("m", [1.0])], "model_name string, a array<double>")
    writers.append_summary(runs, str(tmp_path / "summary"))
    writers.append_summary(runs.withColumn("b", F.lit(2)), str(tmp_path / "summary"))
    got = writers.read_summary(spark, str(tmp_path / "summary")).toPandas()
    assert got.b.isna().tolist() == [False, True]
    calls = []
    build = lambda: calls.append(1) or spark.range(3).toDF("v")
    for _ in range(2):
        assert writers.memoized(spark, str(tmp_path), "key", build).count() == 3
    assert len(calls) == 1
    writers.write_submission(spark.createDataFrame([("b", 1.0), ("a", 2.0)], "seg_id string, time_to_failure double"), str(tmp_path / "sub"))
    text = next((tmp_path / "sub").glob("*.csv")).read_text().split()
    assert text == ["seg_id,time_to_failure", "a,2.0", "b,1.0"]


def test_positions_in_a_burst(spark):
    """All rows of a user in one second of the clock: the ranges split it, and no window holds a user's rows."""
    n = 40_000
    df = spark.range(n).select((F.col("id") % 5 == 0).cast("int").alias("user_id"), F.struct(F.lit(7).alias("ts"), (n - F.col("id")).alias("event_id")).alias("at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little data would become one range
    try:
        got = dense_positions(df.repartition(5), ["user_id"], "at")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # the running sum over ranges is in a written table
    rows = got.select("user_id", "at.event_id", "pos").toPandas().sort_values(["user_id", "event_id"])
    for _, own in rows.groupby("user_id"):
        assert (own.pos.to_numpy() == np.arange(len(own))).all()
    hot = spark.read.parquet(*{f for f in got.inputFiles() if "numbered" in f})
    sizes = hot.filter("user_id = 0").groupBy(F.shiftright("_number", 33)).count().toPandas()["count"]
    assert len(sizes) > 3 and sizes.max() < n / 3


def test_scores_in_rows_as_in_lists(spark):
    from strideframe.functions.columns import list_statistics, score_statistics

    lists = {"a": [1.0, -2.0, 4.0], "b": [3.0], "c": [-1.0, None]}
    rows = spark.createDataFrame([(k, v) for k, vs in lists.items() for v in vs], "k string, v double")
    as_lists = spark.createDataFrame(list(lists.items()), "k string, v array<double>")
    got = {r.k: (r.v_mean, r.v_min, r.v_max, r.v_std) for r in score_statistics(rows, ["k"], "v").collect()}
    want = {r.k: (r.v_mean, r.v_min, r.v_max, r.v_std) for r in list_statistics(as_lists, "v").collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def plain_information(x, b):
    """From the definition: joint frequencies of the rows that have both values."""
    there = ~(np.isnan(x) | np.isnan(b))
    if not there.any():
        return np.nan
    pairs = np.stack([x[there], b[there]])
    entropy = lambda a: -sum(p * np.log(p) for p in np.unique(a, axis=-1, return_counts=True)[1] / there.sum())
    h1, h2, h12 = entropy(pairs[0]), entropy(pairs[1]), entropy(pairs)
    return 1.0 if h1 + h2 == 0 else max(0.0, h1 + h2 - h12) / ((h1 + h2) / 2)


@pytest.mark.parametrize("step", [1, 7])
def test_information_of_all_shifts(step):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 20, 700).astype(float)
    x[100:180] = 3.0  # windows with one bin
    x[300:360] = np.nan  # windows without any value
    x[rng.random(700) < 0.05] = np.nan
    for b in (x[400:440].copy(), np.full(40, 2.0), np.full(40, np.nan)):
        starts = np.arange(0, 700 - 40, step)
        want = [plain_information(x[i:i + 40], b) for i in starts]
        np.testing.assert_allclose(information_of_shifts(x, b, starts), want, atol=1e-9)


def test_both_ways_of_counting_agree_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 97 == 0 else float(v)) for i, v in enumerate(rng.gamma(2.0, 2.0, 3000))]
    s = series(spark.createDataFrame(rows, "p bigint, v double"), "p", "v")
    template = s.filter("pos >= 500 and pos < 550").withColumn("pos", F.col("pos") - 500)
    got = []
    for way in (True, False):
        monkeypatch.setattr(matching, "shifts_are_cheaper", lambda x, b, windows, way=way: way)
        got.append(template_information(s, template, 50, 1, 0.0, 12.0, 2.0, block=400).orderBy("win").toPandas())
    assert len(got[0]) == 2950 and got[0]["nmi"].idxmax() == 500
    np.testing.assert_allclose(got[0]["nmi"], got[1]["nmi"], atol=1e-9)


def test_the_choice_follows_the_overlap():
    x, b = np.arange(100_000.0) % 5, np.arange(20_000.0) % 5
    assert shifts_are_cheaper(x, b, 80_000)
    assert not shifts_are_cheaper(x, b, 10)


def test_segment_files_start_no_process(spark, tmp_path):
    """The files of the partitioned writer, line by line, but not through Hadoop's local file system, which sets permissions by a process."""
    rows = spark.sql("""select * from values (1, 2, cast(null as double)), (1, 1, 1.5d), (2, 1, double('nan')), (2, 2, -1e-9d), (2, 3, 1e22d),
                     (3, 1, cast(null as double)), (null, 1, 2d) t(u, ts, v)""").union(spark.range(4, 300).selectExpr("id", "1", "double(id)"))
    old, new = tmp_path / "old", tmp_path / "new"
    rows.repartition("u").sortWithinPartitions("u", "ts").select("u", "v").write.partitionBy("u").csv(str(old), header=True)
    assert writers.write_segments(rows, f"file://{new}", "u", "ts", "v") == 300
    texts = lambda top: {p.parent.name: p.read_text() for p in top.glob("*/*.csv")}
    assert texts(new) == texts(old) and len(texts(new)) == 300
    assert not list(new.rglob(".*"))  # neither checksums nor files of attempts
    assert readers.find_files(spark, str(new), "*.csv").count() == 300
    back = readers.read_segments(spark, str(new), "v", recursive=True, folder_key="u")
    assert sorted(r.x for r in back.collect() if r.x is not None) == sorted([-1e-9, 1e22, 1.5, 2.0, *map(float, range(4, 300))])
    assert writers.write_segments(rows.limit(0), f"file://{tmp_path}/none", "u", "ts", "v") == 0
    assert (tmp_path / "none").is_dir()
