"""Edge inputs: empty tables, zeros, odd sizes, repeated coordinates, padding, ties; and refusals."""

import pytest
from pyspark.sql import functions as F
from voxelforge.operators import arrange as R
from voxelforge.operators import elementwise as E
from voxelforge.operators import joins as J
from voxelforge.operators import recon as B
from voxelforge.operators import reduce as A
from voxelforge.operators import windows as W
from voxelforge.streaming import frames as X

CELLS = "i int, re double, im double"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture
def line(spark):
    return spark.createDataFrame([(i, float(i), -1.0) for i in range(5)], CELLS)


def test_centre_rule_on_odd_sizes(line):
    assert [r[0] for r in rows(R.resize(line, {"i": (5, 2)}), "i", "re")] == [0, 1]
    assert rows(R.resize(line, {"i": (5, 2)}), "re") == [(1.0,), (2.0,)]
    assert rows(R.resize(line, {"i": (5, 8)}), "i")[0] == (2,)
    assert rows(R.fft_shift(R.fft_shift(line, {"i": 5}), {"i": 5}, inverse=True), "i", "re") == rows(line, "i", "re")


@pytest.mark.parametrize(("mode", "want"), [("wrap", [3, 4, 0, 1, 2, 3, 4, 0]), ("symmetric", [1, 0, 0, 1, 2, 3, 4, 4]), ("reflect", [2, 1, 0, 1, 2, 3, 4, 3])])
def test_pad_modes(line, mode, want):
    assert [r[1] for r in rows(R.pad(line, "i", 5, 2, 1, mode), "i", "re")] == [float(w) for w in want]


def test_refusals(line):
    for call in (lambda: R.pad(line, "i", 5, -1, 0), lambda: R.pad(line, "i", 5, 1, 1, "no"), lambda: R.resize(line, {"i": (5, 3)}, "no"), lambda: E.calc(line, "secret + 1"), lambda: E.calc(line, "re; drop")):
        with pytest.raises(ValueError):
            call()


def test_zero_stays_zero(spark):
    z = spark.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 4.0)], CELLS)
    assert rows(E.invert(z), "re", "im") == [(0.0, 0.0), (0.12, -0.16)]
    assert rows(E.unit_phase(z), "re")[0] == (0.0,)
    assert rows(E.soft_threshold(z, 10.0), "re") == [(0.0,), (0.0,)]
    assert rows(A.normalize(z.withColumn("g", z["i"]), ["g"]), "re") == [(0.0,), (0.6,)]
    assert A.data_scaling(z.where("i = 0").withColumn("g", z["i"]), ["g"]).first()["scale"] == 1.0


def test_repeated_coordinates_add_and_padding_is_ignored(spark, line):
    at = spark.createDataFrame([(0, 1), (1, 1), (2, -1), (3, 4)], "t int, i int")
    got = J.gather(line, at, ["i"])
    assert rows(got, "t", "re") == [(0, 1.0), (1, 1.0), (3, 4.0)]
    assert rows(J.scatter(got, ["i"]), "i", "re") == [(1, 2.0), (4, 4.0)]


def test_interpolation_edges(spark, line):
    q = spark.createDataFrame([(0, 0.0), (1, 4.0), (2, 4.01), (3, 2.5), (4, 1.49)], "q int, c double")
    take = lambda order: dict(rows(J.interpolate(line, q, [("i", "c", 5)], ["q"], order), "q", "re"))
    assert take(1) == {0: 0.0, 1: 4.0, 3: 2.5, 4: pytest.approx(1.49)}
    assert take(0) == {0: 0.0, 1: 4.0, 3: 3.0, 4: 1.0}
    assert take(3)[3] == pytest.approx(2.5)


def test_windows_on_short_series_and_ties(spark):
    s = spark.createDataFrame([(1, 0, 1.0, 0.0), (2, 0, 1.0, 0.0), (2, 1, -1.0, 0.0), (2, 2, 5.0, 0.0)], "ch int, i int, re double, im double")
    assert rows(W.moving_average(s, ["ch"], "i", 3), "ch", "re") == [(2, pytest.approx(5 / 3))]
    assert rows(W.median_filter(s, ["ch"], "i", 3), "re") == [(-1.0,)]
    assert rows(A.top_k(s.where("ch = 2"), ["ch"], [], ["i"], 2), "i") == [(0,), (2,)]
    back = W.hankel_adjoint(W.hankel(s.where("ch = 2"), "i", 3, 2), ["ch"], "i")
    assert rows(back, "i", "re") == [(0, 1.0), (1, -2.0), (2, 5.0)]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "g int, i int, re double, im double")
    for df in (E.absolute(e), R.flip(e, {"i": 3}), A.rss(e, ["g"]), A.normalize(e, ["g"]), A.region_statistics(e, "g"), W.moving_average(e, ["g"], "i", 2), J.scatter(e, ["i"]), A.histogram(e, 4, ["g"])):
        assert df.count() == 0


def test_partition_count_does_not_matter(spark):
    from voxelforge import model

    x = model.signal(spark, "/root/testdata/sf0.001")
    want = None
    for n in (1, 4, 40):
        got = rows(A.total(x.repartition(n), ["ch"]).selectExpr("ch", "round(re, 4) AS re"), "ch", "re")
        want = want or got
        assert got == want


@pytest.fixture(scope="module")
def dealt(spark, tmp_path_factory):
    """The events out of order over twelve files, so that a stream takes several micro-batches."""
    folder = str(tmp_path_factory.mktemp("dealt") / "events")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(12, F.xxhash64("event_id")).sortWithinPartitions(F.xxhash64("ts")).write.parquet(folder)
    return folder


def damped(spark, path, late="40 days"):
    events, close = X.ending(spark, X.source(spark, path), "ts", "user_id")
    return X.run(X.damped(events, "user_id", "ts", "event_id", "value", 0.9, late), "test", close=close).where("user_id >= 0")


def test_damped_stream_equals_the_fold(spark, dealt):
    got = damped(spark, dealt)
    assert got.select("batch").distinct().count() >= 1
    want = rows(X.damped_batch(spark.read.parquet(dealt), "user_id", "ts", "event_id", "value", 0.9), "user_id", "event_id", "state")
    assert [(u, e, pytest.approx(v)) for u, e, v in want] == rows(got, "user_id", "event_id", "state")


def test_late_samples_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "late")
    for event, day, value in ([(1, "2024-01-10", 1.0), (2, "2024-01-01", 5.0), (3, "2024-01-20", 2.0), (4, "2024-01-12", 3.0), (5, "2024-01-05", 9.0)]):
        spark.createDataFrame([(7, event, day, value)], "user_id long, event_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    events, close = X.ending(spark, stream, "ts", "user_id")
    got = X.run(X.damped(events, "user_id", "ts", "event_id", "value", 0.5, "1 day"), "late", close=close).where("user_id >= 0")
    assert rows(got, "event_id", "state") == [(1, 3.5), (2, 5.0), (3, 4.375), (4, 4.75)]  # 5 comes after 1 was released


@pytest.mark.parametrize("mode", ["update"])
def test_frames_and_bins_over_several_micro_batches(spark, dealt, mode):
    table = spark.read.parquet(dealt)
    got = X.latest(X.run(X.frames(X.source(spark, dealt), "user_id", "ts", "value", "1 day", "40 days"), "frames", mode=mode), ["user_id", "start"])
    want = table.groupBy("user_id", F.date_trunc("day", "ts").alias("start")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    assert rows(got.withColumn("total", F.round("total", 6)), "user_id", "start", "n", "total") == rows(want, "user_id", "start", "n", "total")
    labels = table.select("user_id", (F.col("user_id") % 3).alias("g")).distinct()
    got = X.latest(X.run(X.binned(X.source(spark, dealt), labels, "user_id", "g", "value"), "binned", mode=mode), ["g"])
    assert rows(got, "g", "n") == rows(table.groupBy((F.col("user_id") % 3).alias("g")).agg(F.count("*").alias("n")), "g", "n")


def test_both_outputs_of_a_tee_count_a_repeated_batch_once(spark, dealt, tmp_path):
    rest, write = str(tmp_path / "rest"), None
    write = X.tee(rest, "event_type = 'click'")
    table = spark.read.parquet(dealt)

    def twice(batch, number):
        write(batch, number)  # as after a failure
        return write(batch, number)

    kept = X.run(X.source(spark, dealt), "tee", twice)
    assert kept.count() == table.where("event_type = 'click'").count()
    assert spark.read.parquet(rest).count() == table.where("event_type <> 'click'").count()


def test_stack_embed_and_iterate(spark, line):
    both = R.stack([line, E.scale(line, 2.0)], "part")
    assert both.where("part = 1").agg({"re": "sum"}).first()[0] == 20.0
    assert rows(R.embed(R.extract(line, {"i": (2, 4)}), {"i": 2}), "i", "re") == [(2, 2.0), (3, 3.0)]
    assert list(B.iterate(iter([1.0, 1.0, 1.0]), 0.5, lambda y, prior: y + prior)) == [1.0, 1.5, 1.75]
    with pytest.raises(ValueError):
        B.Registry().add("x", adjoint=lambda y: y)


def test_constants_are_added_without_groups(spark):
    tiles = spark.createDataFrame([(1, [1.0, None], [0.0, 2.0]), (2, [5.0], [1.0]), (3, None, None)], "k int, re array<double>, im array<double>")
    one = spark.createDataFrame([([10.0, 20.0], [0.5, 0.0])], "re array<double>, im array<double>")
    got = R.add_to_tiles(tiles, one, 3.0)
    assert "Aggregate" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning" not in plan
    assert sorted(map(tuple, got.select("k", "re", "im").collect()), key=lambda r: r[0]) == [(1, [13.0, 20.0], [0.5, 6.0]), (2, [25.0, 20.0], [3.5, 0.0]), (3, None, None)]


def test_series_are_dealt_to_tasks_by_their_number_of_rows(spark):
    from voxelforge import model

    df = spark.range(1000).withColumn("k", F.col("id") % 500)
    assert model.dealt(df, "k", 10).rdd.getNumPartitions() == 100
    assert model.dealt(df, "k").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    plan = model.signal(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
