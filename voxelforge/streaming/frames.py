"""Structured Streaming jobs: frame assembly, binning, damped recursion and several outputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.shared import shared_folder


def source(spark: SparkSession, path: str) -> DataFrame:
    """Stream of the files at a path (a file or a folder), with the schema that they have now."""
    glob = f"{path[:-1]}[{path[-1]}]"  # as a pattern, the path may also be a single file
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(glob)


def run(stream: DataFrame, name: str, write: Callable[[DataFrame, int], DataFrame] | None = None, mode: str = "append", close: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over all that is there into Parquet in the shared folder and give its table.

    Every micro-batch overwrites its own folder, so a batch that is repeated after a failure counts once.  ``write``
    gives what is kept of a batch; ``close`` adds the last input, and what it releases is read too.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        (write(batch, number) if write else batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/micro_batch={number}")

    def once() -> None:
        stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()

    once()
    if close is not None:  # what only a later watermark would release
        close()
        once()
    return spark.read.parquet(f"{base}/out").drop("micro_batch")


def tee(folder: str, condition: str) -> Callable[[DataFrame, int], DataFrame]:
    """A ``write`` for ``run``: rows that miss the condition go to ``folder``, a batch that is repeated overwrites its own part."""

    def write(batch: DataFrame, number: int) -> DataFrame:
        batch.where(f"NOT coalesce({condition}, false)").write.mode("overwrite").parquet(f"{folder}/micro_batch={number}")
        return batch.where(condition)

    return write


def frames(events: DataFrame, key: str, time: str, value: str, width: str, late: str) -> DataFrame:
    """Samples assembled into frames of fixed length in time; later samples than the watermark are dropped."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(key, w).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("window.start").alias("start"), "n", "total")


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of every key of an update-mode table."""
    cols = [c for c in table.columns if c not in (*keys, "batch")]
    return table.groupBy(*keys).agg(*(F.max_by(c, "batch").alias(c) for c in cols))


def binned(events: DataFrame, labels: DataFrame, key: str, label: str, value: str) -> DataFrame:
    """Stream-static join with a label table, then sums by label."""
    return events.join(labels, key).groupBy(label).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def ending(spark: SparkSession, rows: DataFrame, time: str) -> tuple[DataFrame, Callable[[], None]]:
    """(stream with a column ``is_end``, function that sends the end).

    The end is one row that has only a time, long after every sample, and is told apart by ``is_end``; it moves the watermark
    past all samples.  Operators with state keep it in a group of its own.
    """
    folder = f"{shared_folder(spark)}/end-{uuid.uuid4().hex}"
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
    last = spark.range(1).select(*nulls).withColumns({time: F.lit("2200-01-01").cast(rows.schema[time].dataType), "is_end": F.lit(True)})
    last.where("false").write.parquet(folder)
    return rows.withColumn("is_end", F.lit(False)).unionByName(spark.readStream.schema(last.schema).parquet(folder)), lambda: last.write.mode("append").parquet(folder)


def frames_by_count(items: DataFrame, keys: list[str], index: str, value: str, time: str, size: int, late: str, buckets: int = 512) -> DataFrame:
    """Frames of ``size`` items by their running index: (keys, frame, n, complete, total), frame = index div size.

    A frame is emitted once, in the batch in which its last missing item comes.  Items of an index that is there already
    are left out, as are items of a frame that was emitted.  A frame that misses items is emitted as it is, not complete, when the
    watermark has passed the latest of its items by ``late``; items after that are late and dropped.  Frames are dealt to
    ``buckets`` groups by hash, whose frames are handled as arrays; the state is the values of a bucket's open frames.
    """
    types = {f.name: f.dataType for f in items.select(*keys).schema}
    instants = [n for n in keys if types[n].typeName() == "timestamp"]  # kept as whole numbers in the state
    column = lambda n: "bigint" if n in instants else types[n].simpleString()
    names = [*keys, "frame"]
    form = ", ".join(f"`{n}` array<{column(n)}>" for n in keys) + ", frame array<long>, last array<long>, closed array<boolean>, count array<int>, places binary, held binary"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = [n for n, null in zip(names, [*key[2:], False], strict=True) if not null]  # a group has no or only nulls of a key
        *ids, last, closed, count, places, held = state.get if state.exists else (*([] for _ in names), [], [], [], b"", b"")
        old = pd.DataFrame({n: v for n, v in zip(names, ids, strict=True) if n in known})
        new = [] if state.hasTimedOut else list(batches)
        new = pd.concat(new).sort_values("__ms", kind="stable") if new else None
        every = old if new is None else pd.concat([old, new[known]]) if len(old) else new[known]
        code = every.groupby(known, sort=False, dropna=False).ngroup().to_numpy()  # those of the state come first, as they are
        ends = np.full(code.max(initial=-1) + 1, np.iinfo(np.int64).min)
        shut = np.zeros(len(ends), bool)
        ends[: len(old)], shut[: len(old)] = last, closed
        own, at, v = np.repeat(np.arange(len(old)), count), np.frombuffer(places, np.int32), np.frombuffer(held, float)
        if new is not None:
            np.maximum.at(ends, code[len(old) :], new["__ms"].to_numpy(np.int64))
            fresh = ~shut[code[len(old) :]]
            own = np.concatenate([own, code[len(old) :][fresh]])
            at, v = np.concatenate([at, new["__at"].to_numpy(np.int32)[fresh]]), np.concatenate([v, new[value].to_numpy(float)[fresh]])
        _, once = np.unique(own * size + at, return_index=True)  # the first of an index; by frame and place
        own, at, v = own[once], at[once], v[once]
        n = np.bincount(own, minlength=len(ends))
        over = ends + 1 < state.getCurrentWatermarkMs()
        emit = ~shut & ((n == size) | over)
        _, first = np.unique(code, return_index=True)
        frames = every.iloc[first]
        if emit.any():
            said = frames[emit]
            yield pd.DataFrame({**{k: said[k].to_numpy() if k in known else [None] * len(said) for k in names}, "n": n[emit], "complete": n[emit] == size, "total": np.bincount(own, v, len(ends))[emit]})
        stay = ~over
        if not stay.any():
            state.remove()
            return
        shut |= emit
        kept = frames[stay]
        open_ = (stay & ~shut)[own]
        state.update((*(kept[k].tolist() if k in known else [] for k in names), ends[stay].tolist(), shut[stay].tolist(), np.where(shut, 0, n)[stay].tolist(), at[open_].astype(np.int32).tobytes(), v[open_].tobytes()))
        state.setTimeoutTimestamp(int(max(ends[stay].min() + 1, state.getCurrentWatermarkMs() + 1)))

    kept = ", ".join(f"`{n}` {column(n)}" for n in keys)
    ends = F.col("is_end") if "is_end" in items.columns else F.lit(False)  # such a row only moves the watermark
    rows = items.withWatermark(time, late).where(ends | (F.col(index).isNotNull() & F.col(value).isNotNull() & F.col(time).isNotNull()))
    own = [F.unix_micros(n).alias(n) if n in instants else F.col(n) for n in keys]
    frame = F.floor(F.col(index) / size).cast("long")
    nulls = [F.col(n).isNull().alias(f"__null{i}") for i, n in enumerate(keys)]
    rows = rows.select(*own, frame.alias("frame"), ends.alias("__end"), F.pmod(F.xxhash64(*keys, frame), F.lit(buckets)).cast("int").alias("__bucket"), *nulls, F.pmod(F.col(index), F.lit(size)).cast("int").alias("__at"), F.col(value).cast("double").alias(value), time, F.unix_millis(F.col(time).cast("timestamp")).alias("__ms"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return iter(()) if key[1] else step(key, batches, state)

    got = rows.groupBy("__bucket", "__end", *(f"__null{i}" for i in range(len(keys)))).applyInPandasWithState(run, f"{kept}, frame long, n long, complete boolean, total double", form, "append", GroupStateTimeout.EventTimeTimeout)
    return got.withColumns({n: F.timestamp_micros(n) for n in instants}) if instants else got


def damped_images(frames: DataFrame, key: str, frame: str, time: str, late: str, solve: Callable[[np.ndarray, np.ndarray], np.ndarray], damp: float = 0.9) -> DataFrame:
    """Frames of a slice one after the other, each solved with ``damp`` times its predecessor's image as the prior.

    Rows are (key, frame, time, re, im) with flat arrays; ``solve(y, prior)`` takes and gives flat complex arrays.  The state is the
    slice's last image and the frames that wait for an earlier one.  Frames count from 0; a gap is given up when the watermark has
    passed the frame behind it; frames at or before the last one that was solved, and repeats of one that waits, are dropped.
    """
    form = "done long, last binary, at array<long>, ms array<long>, held array<binary>"
    some = 1000  # frames that are put out at once

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, last, at, ms, held = state.get if state.exists else (-1, None, [], [], [])
        waiting = {a: (t, np.frombuffer(v, complex)) for a, t, v in zip(at, ms, held, strict=True)}
        last = None if last is None else np.frombuffer(last, complex)
        mark, out = state.getCurrentWatermarkMs(), []

        def solved(at: int) -> None:
            nonlocal last, done
            y = waiting.pop(at)[1]
            last, done = solve(y, np.zeros_like(y) if last is None else damp * last), at
            out.append((at, last))

        def table() -> pd.DataFrame:
            got = pd.DataFrame({key: [k[0]] * len(out), frame: [f for f, _ in out], "re": [v.real for _, v in out], "im": [v.imag for _, v in out]})
            out.clear()
            return got

        for pdf in [] if state.hasTimedOut else batches:
            for f, t, re, im in zip(pdf["frame"], pdf["ms"], pdf["re"], pdf["im"], strict=True):
                if f > done:
                    waiting.setdefault(int(f), (int(t), np.asarray(re, float) + 1j * np.asarray(im, float)))
                while done + 1 in waiting:  # what has its predecessor goes at once, so only frames behind a gap are kept
                    solved(done + 1)
                if len(out) >= some:
                    yield table()
        for first in sorted(waiting):
            if first != done + 1 and waiting[first][0] > mark:
                break
            solved(first)
            if len(out) >= some:
                yield table()
        order = sorted(waiting)
        if last is not None or order:
            state.update((done, None if last is None else np.asarray(last, complex).tobytes(), order, [waiting[i][0] for i in order], [waiting[i][1].tobytes() for i in order]))
        if order:
            state.setTimeoutTimestamp(max(mark + 1, waiting[order[0]][0] + 1))
        yield table()

    rows = frames.withWatermark(time, late).where(F.col(key).isNotNull() & F.col(frame).isNotNull() & F.col(time).isNotNull())
    rows = rows.select(key, F.col(frame).cast("long").alias("frame"), F.unix_millis(F.col(time).cast("timestamp")).alias("ms"), "re", "im", time)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, {frame} long, re array<double>, im array<double>", form, "append", GroupStateTimeout.EventTimeTimeout)


def damped(events: DataFrame, key: str, time: str, order: str, value: str, damp: float, late: str) -> DataFrame:
    """Per key, in order of time: state = value + damp * state; one row per sample.

    Samples wait in the state until the watermark has passed them, so their order does not depend on how
    they are dealt over micro-batches.  Samples without a value are left out; those that are older than the
    last one that was released are late and dropped.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, done, *held = state.get if state.exists else (0.0, -1, b"", b"", b"")
        parts = [[np.frombuffer(h, form) for h, form in zip(held, (np.int64, np.int64, float), strict=True)]]
        for p in [] if state.hasTimedOut else batches:
            p = p[p[order].notna() & p[value].notna()]  # the row that ends a stream has neither
            parts.append([p[c].to_numpy(form) for c, form in ((time, np.int64), (order, np.int64), (value, float))])
        t, o, v = (np.concatenate(c) for c in zip(*parts, strict=True))
        by = np.lexsort((o, t))
        by = by[t[by] > done]
        mark = state.getCurrentWatermarkMs()
        free, rest = by[t[by] <= mark], by[t[by] > mark]
        out = []
        for x in v[free].tolist():
            last = x + damp * last
            out.append(last)
        if len(free):
            done = int(t[free[-1]])
        state.update((float(last), int(done), *(c[rest].tobytes() for c in (t, o, v))))
        if len(rest):
            state.setTimeoutTimestamp(max(mark + 1, int(t[rest[0]])))
        yield pd.DataFrame({key: k[0], order: o[free], "state": np.array(out, float)})

    end = ["is_end"] if "is_end" in events.columns else []
    rows = events.withWatermark(time, late).select(key, *end, F.unix_millis(F.col(time).cast("timestamp")).alias(f"{time}_ms"), time, order, value)
    form = "last double, done long, times binary, orders binary, held binary"
    rows = rows.withColumnsRenamed({time: "__at", f"{time}_ms": time}).where("__at IS NOT NULL")
    return rows.groupBy(key, *end).applyInPandasWithState(step, f"{key} long, {order} long, state double", form, "append", GroupStateTimeout.EventTimeTimeout)


def damped_batch(rows: DataFrame, key: str, time: str, order: str, value: str, damp: float) -> DataFrame:
    """The same recursion over a table, as an ordered fold."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        last, out = 0.0, []
        pdf = pdf.sort_values([time, order])
        for v in pdf[value]:
            last = v + damp * last
            out.append(last)
        return pd.DataFrame({key: pdf[key], order: pdf[order], "state": out})

    return rows.select(key, time, order, value).groupBy(key).applyInPandas(fold, f"{key} long, {order} long, state double")
