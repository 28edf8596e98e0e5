"""Raw array files: a text header with dimensions beside little-endian complex64 data in Fortran order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import small_batches

#: A binary file that is larger than a row of this many bytes still takes a batch of its own.
FILE_BYTES = 1_000_000
DIMS = 16
TILE = "array_id string, shape array<int>, re array<float>, im array<float>"


def parse_header(text: str) -> list[int]:
    """First line that is not a comment; trailing ones are dropped."""
    line = next(x for x in text.splitlines() if x.strip() and not x.startswith("#"))
    dims = [int(x) for x in line.split()]
    while len(dims) > 1 and dims[-1] == 1:
        dims.pop()
    return dims


def format_header(dims: list[int]) -> str:
    return "# Dimensions\n" + " ".join(map(str, dims + [1] * (DIMS - len(dims)))) + "\n"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One tile per file pair; values in C order of ``shape`` (the reversed dimensions).

    Headers, a few bytes each, are shuffled by name; batches of contents hold few files, as these may be large.
    """
    small_batches(spark, FILE_BYTES)
    files = lambda ending: spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(folder).select(F.regexp_extract("path", rf"([^/]+)\{ending}$", 1).alias("array_id"), "content")
    both = files(".hdr").withColumnRenamed("content", "header").join(files(".cfl"), "array_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                dims, x = parse_header(r.header.decode()), np.frombuffer(r.content, "<c8")
                if int(np.prod(dims)) != len(x):
                    raise ValueError(f"{r.array_id}: {len(x)} values for dimensions {dims}")
                rows.append((r.array_id, dims[::-1], x.real.copy(), x.imag.copy()))
            yield pd.DataFrame(rows, columns=["array_id", "shape", "re", "im"])

    return both.mapInPandas(run, TILE)


def write_raw(tiles: DataFrame, folder: str) -> DataFrame:
    """Write the samples of each row of (array_id, re, im), in their order, as one file of little-endian complex64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.stack([np.asarray(batch.column(c)[i].values.to_numpy(zero_copy_only=False), "<f4") for c in (1, 2)], 1)
                with store.open_output_stream(f"{root}/{batch.column(0)[i].as_py()}.raw") as f:
                    f.write(np.ascontiguousarray(x).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["array_id"])

    return tiles.select("array_id", "re", "im").mapInArrow(run, "array_id string")


def read_raw(spark: SparkSession, folder: str) -> DataFrame:
    """(array_id, re, im) of a folder of raw files."""
    small_batches(spark, FILE_BYTES)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.raw").load(folder).select(F.regexp_extract("path", r"([^/]+)\.raw$", 1).alias("array_id"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(1)[i].as_py(), "<f4").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([x[:, j]], pa.list_(pa.float32())) for j in (0, 1))], ["array_id", "re", "im"])

    return files.mapInArrow(run, "array_id string, re array<float>, im array<float>")


def write(tiles: DataFrame, folder: str) -> DataFrame:
    """Write one file pair per row of (array_id, shape, re, im) into a folder that all executors share.

    Gives the written names; nothing is written before an action asks for them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for pdf in batches:
            for r in pdf.itertuples():
                x = (np.asarray(r.re, np.float32) + 1j * np.asarray(r.im, np.float32)).astype("<c8")
                for ending, data in ((".hdr", format_header([int(n) for n in r.shape[::-1]]).encode()), (".cfl", x.tobytes())):
                    with store.open_output_stream(f"{root}/{r.array_id}{ending}") as f:
                        f.write(data)
            yield pd.DataFrame({"array_id": pdf["array_id"]})

    return tiles.select("array_id", "shape", "re", "im").mapInPandas(run, "array_id string")
