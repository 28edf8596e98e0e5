"""Raw array files of any size, read and written in slabs.

A file pair is a text header with dimensions and little-endian complex64 values in Fortran order.  The
reader is a Spark data source: it plans byte ranges from the headers, and every partition reads its own
ranges only, so an array may exceed a row, a task and an executor by far.  Ranges need not be aligned
with any axis.  A slab row carries the position of its first value; flat positions count in C order of
the reversed dimensions, the ``shape`` of all tables here.

Writing is two steps.  Every slab becomes a file of its own, then one task per array joins them in order through
a small buffer; gaps, overlaps and sizes that the shape contradicts raise before the pair is put in place.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import unflatten
from .cfl import format_header, parse_header

SLAB = "array_id string, shape array<int>, start long, re array<float>, im array<float>"
VALUE_BYTES = 8
#: Bytes that a partition reads, of one file or of many small ones, and values of a row.
PARTITION_BYTES, ROW_VALUES = 64_000_000, 262_144


@dataclass
class Ranges(InputPartition):
    """(array_id, dimensions, path, first value, number of values) of every piece that a partition reads."""

    pieces: list[tuple[str, tuple[int, ...], str, int, int]]


def plan(sizes: Sequence[tuple[str, tuple[int, ...], str]], most: int) -> list[Ranges]:
    """Cut arrays (id, dimensions, path) into ranges of at most ``most`` values; small ones share a partition."""
    out: list[Ranges] = []
    room = 0
    for name, dims, path in sizes:
        at, n = 0, math.prod(dims)
        while at < n:
            if room == 0 or (at == 0 and n <= most and n > room):
                out.append(Ranges([]))
                room = most
            take = min(room, n - at)
            out[-1].pieces.append((name, dims, path, at, take))
            at, room = at + take, room - take
    return out


class SlabReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.most = max(1, int(options.get("partitionbytes", PARTITION_BYTES)) // VALUE_BYTES)
        self.row = max(1, int(options.get("rowvalues", ROW_VALUES)))

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        found = {f.path: f.size for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File}
        arrays = []
        for path in sorted(found):
            if not path.endswith(".hdr"):
                continue
            name, data = re.search(r"([^/]+)\.hdr$", path)[1], path[:-4] + ".cfl"
            with store.open_input_stream(path) as f:
                dims = tuple(parse_header(f.read(65_536).decode()))
            if found.get(data) != math.prod(dims) * VALUE_BYTES:
                raise ValueError(f"{name}: {found.get(data)} bytes for dimensions {list(dims)}")
            arrays.append((name, dims, data))
        return plan(arrays, self.most) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.folder)
        for name, dims, path, first, count in partition.pieces:
            with store.open_input_file(path) as f:
                f.seek(first * VALUE_BYTES)
                for at in range(first, first + count, self.row):
                    n = min(self.row, first + count - at)
                    x = np.frombuffer(f.read(n * VALUE_BYTES), "<f4").reshape(-1, 2)
                    if len(x) != n:
                        raise ValueError(f"{name}: the file ended early")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([list(dims[::-1])], pa.list_(pa.int32())), pa.array([at], pa.int64()), *(pa.array([x[:, j]], pa.list_(pa.float32())) for j in (0, 1))],
                        ["array_id", "shape", "start", "re", "im"],
                    )


class RawArrays(DataSource):
    """``spark.read.format("rawarrays").load(folder)``; options ``partitionBytes`` and ``rowValues``."""

    @classmethod
    def name(cls) -> str:
        return "rawarrays"

    def schema(self) -> str:
        return SLAB

    def reader(self, schema) -> SlabReader:
        return SlabReader({k.lower(): v for k, v in self.options.items()})


def read_slabs(spark: SparkSession, folder: str, partition_bytes: int = PARTITION_BYTES, row_values: int = ROW_VALUES) -> DataFrame:
    """Slabs (array_id, shape, start, re, im) of all arrays of a folder."""
    spark.dataSource.register(RawArrays)
    return spark.read.format("rawarrays").option("partitionBytes", partition_bytes).option("rowValues", row_values).load(folder)


def slabs_to_cells(slabs: DataFrame, axes: Sequence[str]) -> DataFrame:
    """A row per value with its axis positions, without a shuffle."""
    keep = [c for c in slabs.columns if c not in ("shape", "start", "re", "im")]
    flat = slabs.select(*keep, "shape", "start", F.posexplode(F.arrays_zip("re", "im")).alias("__p", "__v"))
    at = unflatten(F.col("start") + F.col("__p"), axes, [F.get("shape", F.lit(i)) for i in range(len(axes))])
    return flat.select(*keep, *(c.alias(a) for a, c in at.items()), F.col("__v.re").cast("double").alias("re"), F.col("__v.im").cast("double").alias("im"))


def write_slabs(slabs: DataFrame, folder: str) -> DataFrame:
    """Write slabs (array_id, shape, start, re, im) as file pairs; gives (array_id, bytes) once an action asks for it.

    The folder must be shared by all executors.  Tasks may be repeated: a slab's file is named by its place.
    """
    parts = f"_slabs-{uuid.uuid4().hex}"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for i in range(b.num_rows):
                name, start = b.column("array_id")[i].as_py(), b.column("start")[i].as_py()
                x = np.stack([np.asarray(b.column(c)[i].values.to_numpy(zero_copy_only=False), "<f4") for c in ("re", "im")], 1)
                store.create_dir(f"{root}/{parts}/{name}", recursive=True)
                with store.open_output_stream(f"{root}/{parts}/{name}/{start}") as f:
                    f.write(np.ascontiguousarray(x).tobytes())
                yield pa.RecordBatch.from_arrays([b.column("array_id").slice(i, 1), b.column("shape").slice(i, 1), pa.array([start], pa.int64()), pa.array([len(x)], pa.int64())], ["array_id", "shape", "start", "n"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for row in b.to_pylist():
                name, at = row["array_id"], 0
                for p in row["parts"]:
                    if p["start"] != at:
                        raise ValueError(f"{name}: a slab begins at {p['start']} instead of {at}")
                    at += p["n"]
                if row["other"] or at != math.prod(row["shape"]):
                    raise ValueError(f"{name}: {at} values for the shape {row['shape']}")
                with store.open_output_stream(f"{root}/{parts}/{name}/whole") as out:
                    for p in row["parts"]:
                        with store.open_input_stream(f"{root}/{parts}/{name}/{p['start']}") as f:
                            while block := f.read(8_000_000):
                                out.write(block)
                store.move(f"{root}/{parts}/{name}/whole", f"{root}/{name}.cfl")
                with store.open_output_stream(f"{root}/{name}.hdr") as out:
                    out.write(format_header([int(n) for n in row["shape"][::-1]]).encode())
                store.delete_dir(f"{root}/{parts}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at * VALUE_BYTES], pa.int64())], ["array_id", "bytes"])

    written = slabs.select("array_id", "shape", "start", "re", "im").mapInArrow(pieces, "array_id string, shape array<int>, start long, n long").dropDuplicates(["array_id", "start", "n"])
    lists = written.groupBy("array_id").agg(F.max("shape").alias("shape"), (F.max("shape") != F.min("shape")).alias("other"), F.array_sort(F.collect_list(F.struct("start", "n"))).alias("parts"))
    return lists.mapInArrow(join, "array_id string, bytes long")
