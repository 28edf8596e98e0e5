"""Frames by count and images on a stream, over many micro-batches."""

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from voxelforge.streaming import frames as X


def folder_of(spark, schema):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    put = lambda rows: spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(folder)
    put([])
    return folder, put


def stream(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_frames_by_count_with_gaps_repeats_and_late_items(spark):
    folder, put = folder_of(spark, "k string, i long, v double, ts double")
    item = lambda k, i, v=None, t=None: (k, i, float(i if v is None else v), 1000.0 + (i if t is None else t))
    batches = [
        [item("a", 2), item("a", 0)], [item("a", 1), item("a", 0, 99)], [item("a", 3)],  # whole, with a repeat of another value
        [item("a", 1, 99)], [item("b", 5), item("b", 4)], [item("b", 7)],  # a repeat after the frame; a frame without 6
        [("b", None, 1.0, 1005.0), ("b", 0, None, 1000.0), (None, 0, 1.0, 1000.0)], [item("c", i) for i in (40, 41, 42, 43)],  # nulls; the watermark moves on
        [item("b", 40)], [item("b", 6, 99)], [item("a", 41), item("a", 42)], [item("a", 43), item("a", 40)],  # 6 is late
    ]
    for rows in batches:
        put(rows)
    items, end = X.ending(spark, stream(spark, folder), "ts")
    got = X.run(X.frames_by_count(items, ["k"], "i", "v", "ts", 4, "10 seconds"), "counted", close=end)
    rows = sorted((r["k"] or "", r["frame"], r["n"], r["complete"], r["total"]) for r in got.collect())
    assert rows == [("", 0, 1, False, 1.0), ("a", 0, 4, True, 6.0), ("a", 10, 4, True, 166.0), ("b", 1, 3, False, 16.0), ("b", 10, 1, False, 40.0), ("c", 10, 4, True, 166.0)]


def test_images_are_the_ordered_fold_over_a_restart(spark):
    rng = np.random.default_rng(1)
    folder, put = folder_of(spark, "slice long, frame long, ts double, re array<double>, im array<double>")
    y = {(s, f): rng.normal(size=6) + 1j * rng.normal(size=6) for s in range(3) for f in range(8)}
    row = lambda s, f: (s, f, 1000.0 + f, y[s, f].real.tolist(), y[s, f].imag.tolist())
    order = [(s, f) for f in (1, 0, 3, 2, 2, 5, 7, 4, 6, 0) for s in range(3)]
    for i in range(0, 15, 3):
        put([row(*k) for k in order[i : i + 3]])

    def rest():
        for i in range(15, len(order), 3):
            put([row(*k) for k in order[i : i + 3]])

    solve = lambda v, prior: (v + prior) / 1.5
    got = {(r["slice"], r["frame"]): np.array(r["re"]) + 1j * np.array(r["im"]) for r in X.run(X.damped_images(stream(spark, folder), "slice", "frame", "ts", "1 hour", solve), "images", close=rest).collect()}
    assert len(got) == 24
    for s in range(3):
        last = np.zeros(6)
        for f in range(8):
            last = solve(y[s, f], 0.9 * last)
            np.testing.assert_allclose(got[s, f], last)


def test_frames_by_count_come_in_few_groups(spark):
    """Long keys beside null, frames that share a bucket, one of them given up; the state has a row per bucket, not per frame."""
    big = 2**53 + 1
    folder, put = folder_of(spark, "k long, i long, v double, ts double")
    for r in range(3):
        put([(k, 3 * f + r, float(f), 1000.0 + f) for k in (None, big, big + 1) for f in range(50) if (k, f, r) != (big, 7, 2)])
    items, end = X.ending(spark, stream(spark, folder), "ts")
    frames = X.frames_by_count(items, ["k"], "i", "v", "ts", 3, "1 hour", buckets=4)
    got = sorted((r["k"] or 0, r["frame"], r["n"], r["complete"], r["total"]) for r in X.run(frames, "counted", close=end).collect())
    assert got == sorted((k, f, 2 if (k, f) == (big, 7) else 3, (k, f) != (big, 7), (2.0 if (k, f) == (big, 7) else 3.0) * f) for k in (0, big, big + 1) for f in range(50))


def test_images_in_order_leave_nothing_to_wait(spark):
    """A slice of many frames in one batch comes out in pieces while it is read; a gap at the end is given up."""
    folder, put = folder_of(spark, "slice long, frame long, ts double, re array<double>, im array<double>")
    put([(0, f, 1000.0 + f, [1.0, float(f)], [0.0, -1.0]) for f in range(2500) if f != 2400])
    taken = spark.sparkContext.accumulator(0)

    def solve(v, prior):
        taken.add(1)
        return v + 0 * prior

    rows = X.run(X.damped_images(stream(spark, folder), "slice", "frame", "ts", "1 day", solve), "images").collect()
    assert taken.value == 2400
    assert sorted(r["frame"] for r in rows) == list(range(2400))  # those behind the gap wait
    assert all(r["re"] == [1.0, float(r["frame"])] and r["im"] == [0.0, -1.0] for r in rows)


def test_images_are_put_out_while_frames_are_read(spark, monkeypatch):
    """What a group gives comes in tables of at most 1000 frames, before its last input was read."""
    got = {}

    class Caught:
        def __getattr__(self, name):
            return lambda *a, **k: got.setdefault("step", a[0]) if name == "applyInPandasWithState" else self

    class State:
        exists, hasTimedOut = False, False
        getCurrentWatermarkMs = lambda self: 0
        update = setTimeoutTimestamp = lambda self, v: got.update(state=v)

    monkeypatch.setattr(X.F, "col", lambda *a: Caught())
    monkeypatch.setattr(X.F, "unix_millis", lambda *a: Caught())
    monkeypatch.setattr(Caught, "__and__", lambda a, b: a, raising=False)
    X.damped_images(Caught(), "slice", "frame", "ts", "1 day", lambda v, prior: v)
    read = []

    def batches():
        for i in range(5):
            read.append(i)
            yield pd.DataFrame({"frame": range(1000 * i, 1000 * i + 1000), "ms": 0, "re": [[1.0]] * 1000, "im": [[0.0]] * 1000})

    tables = [(len(read), len(t)) for t in got["step"]((0,), batches(), State())]
    assert [n for _, n in tables] == [1000] * 5 + [0]
    assert tables[0][0] == 1
    assert not got["state"][2]


def test_samples_that_wait_are_bytes_in_the_state(spark):
    """The recursion over two keys, dealt out of order, with identifiers beyond doubles and one sample without a value."""
    folder, put = folder_of(spark, "k long, o long, v double, ts double")
    big = 2**53
    put([(k, big + i, None if i == 4 else float(i), 1000.0 + 9 - i) for k in (1, 2) for i in range(9)])
    items, end = X.ending(spark, stream(spark, folder), "ts")
    damped = X.damped(items, "k", "ts", "o", "v", 0.5, "1 day")
    got = {(r["k"], r["o"]): r["state"] for r in X.run(damped, "damped", close=end).collect()}
    for k in (1, 2):
        last = 0.0
        for i in (8, 7, 6, 5, 3, 2, 1, 0):
            last = i + 0.5 * last
            assert got[k, big + i] == last
    assert len(got) == 16
    import inspect

    assert "held binary" in inspect.getsource(X.damped)
