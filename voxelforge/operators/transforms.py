"""Dense transforms: NumPy helpers over Arrow batches of tiles, and small matrices solved on the driver.

A tile row carries flat ``re`` and ``im`` arrays.  Whole batches are stacked, so no Python code runs per cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..model import dealt, pieces, small_batches
from . import windows
from .joins import fmac
from .reduce import channel_gram, gram_of_tiles

MAX_DRIVER_SIDE = 512  # channels or frames of a matrix that the driver may solve


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(float)


def _lists(x: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(x.reshape(len(x), -1), float)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


def _stacks(batch: pa.RecordBatch, shapes: Sequence[Sequence[int] | None], inputs: Sequence[tuple[str, str]]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of rows of one shape and of bounded size, with each input stacked.

    A shape of None is the one in the row's ``shape`` column, a function is applied to that one.
    """
    if not batch.num_rows:
        return
    groups: dict[tuple, list[int]] = {(): list(range(batch.num_rows))}
    if any(s is None or callable(s) for s in shapes):
        groups = {}
        for i, own in enumerate(batch.column("shape").to_pylist()):
            groups.setdefault(tuple(own), []).append(i)
    for own, rows in groups.items():
        some = batch if len(rows) == batch.num_rows else batch.take(pa.array(rows))
        sizes = [tuple(own if s is None else s(own) if callable(s) else s) for s in shapes]
        for b in pieces(some, 16 * sum(int(np.prod(s)) for s in sizes)):
            yield b, [(_flat(b, r) + 1j * _flat(b, i)).reshape(-1, *s) for (r, i), s in zip(inputs, sizes, strict=True)]


def _declared(tiles: DataFrame, shape: Sequence[int] | None, inputs: Sequence, shapes: Sequence | None) -> list:
    out = list(shapes) if shapes is not None else [shape] * len(inputs)
    small_batches(tiles.sparkSession, 16 * sum(4096 if s is None or callable(s) else int(np.prod(s)) for s in out))
    return out


def tile_map(tiles: DataFrame, shape: Sequence[int] | None, fn: Callable[..., np.ndarray], inputs: Sequence[tuple[str, str]] = (("re", "im"),), shapes: Sequence[Sequence[int] | None] | None = None) -> DataFrame:
    """Replace shape, re and im by those of ``fn`` of the stacked tiles.

    Further inputs name more column pairs, ``shapes`` their shapes where they differ.  Without a shape the
    rows' own ``shape`` counts, and tiles of several shapes may be mixed.
    """
    used = {c for p in inputs for c in p} | {"re", "im", "shape"}
    keep = [f for f in tiles.schema if f.name not in used]
    array = lambda t: T.ArrayType(t)
    out = T.StructType([*keep, T.StructField("shape", array(T.IntegerType())), T.StructField("re", array(T.DoubleType())), T.StructField("im", array(T.DoubleType()))])
    names, every = [f.name for f in keep], _declared(tiles, shape, inputs, shapes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, own in _stacks(batch, every, inputs):
                y = fn(*own)
                dims = np.tile(np.array(y.shape[1:], np.int32), (len(y), 1))
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * dims.shape[1], pa.int32()), pa.array(dims.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), made, _lists(y.real), _lists(np.imag(y) + np.zeros(y.shape))], [*names, "shape", "re", "im"])

    return tiles.mapInArrow(run, out)


def tile_values(tiles: DataFrame, shape: Sequence[int] | None, fn: Callable[..., np.ndarray], names: Sequence[str], inputs: Sequence[tuple[str, str]] = (("re", "im"),), shapes: Sequence[Sequence[int] | None] | None = None) -> DataFrame:
    """A column per value that ``fn`` gives for each tile."""
    used = {c for p in inputs for c in p} | {"shape"}
    keep = [f for f in tiles.schema if f.name not in used]
    out = T.StructType([*keep, *(T.StructField(n, T.DoubleType()) for n in names)])
    kept, every = [f.name for f in keep], _declared(tiles, shape, inputs, shapes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, own in _stacks(batch, every, inputs):
                y = np.asarray(fn(*own), float).reshape(b.num_rows, len(names))
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), *(pa.array(y[:, i]) for i in range(len(names)))], [*kept, *names])

    return tiles.mapInArrow(run, out)


def fft(tiles: DataFrame, shape: Sequence[int] | None = None, inverse: bool = False, unitary: bool = False, centred: bool = True) -> DataFrame:
    """Transform over all axes of every tile."""
    return tile_map(tiles, shape, lambda x: kernels.fft(x, tuple(range(1, x.ndim)), inverse, unitary, centred))


def nufft(tiles: DataFrame, shape: Sequence[int] | None, trajectory: np.ndarray, weights: np.ndarray | None = None, basis: np.ndarray | None = None) -> DataFrame:
    """Samples of images (y, x); with a basis (a, t) of coefficient images (a, y, x), as frames (t, sample)."""
    if basis is None:
        return tile_map(tiles, shape, lambda x: kernels.nufft(x, trajectory, weights))
    return tile_map(tiles, shape, lambda x: np.einsum("at,abs->bts", basis, np.stack([kernels.nufft(x[:, a], trajectory, weights) for a in range(len(basis))])))


def nufft_adjoint(samples: DataFrame, image: tuple[int, int], trajectory: np.ndarray, weights: np.ndarray | None = None, basis: np.ndarray | None = None) -> DataFrame:
    """Adjoint of ``nufft``."""
    if basis is None:
        return tile_map(samples, (len(trajectory),), lambda y: kernels.nufft_adjoint(y, trajectory, image, weights))
    n_frames = basis.shape[1]
    return tile_map(samples, (n_frames, len(trajectory)), lambda y: np.stack([kernels.nufft_adjoint(np.einsum("t,bts->bs", np.conj(c), y), trajectory, image, weights) for c in basis], 1))


def psf(weights: DataFrame, trajectory: np.ndarray, image: tuple[int, int]) -> DataFrame:
    """Point spread function on the doubled grid of the squared sizes of each row's weights, one per sample."""
    return tile_map(weights, (len(trajectory),), lambda w: kernels.psf(np.abs(w) ** 2, trajectory, image))


def to_matrix(rows: list, n: int) -> np.ndarray:
    """Hermitian matrix from its upper triangle (i, j, re, im)."""
    if n > MAX_DRIVER_SIDE:
        raise ValueError(f"a side of {n} is too large for the driver")
    m = np.zeros((n, n), complex)
    for r in rows:
        m[r["i"], r["j"]] = r["re"] + 1j * r["im"]
        m[r["j"], r["i"]] = r["re"] - 1j * r["im"]
    return m


def matrix_frame(df: DataFrame, m: np.ndarray, out: str, axis: str) -> DataFrame:
    rows = [(int(o), int(a), float(m[o, a].real), float(m[o, a].imag)) for o in range(m.shape[0]) for a in range(m.shape[1])]
    return df.sparkSession.createDataFrame(rows, f"{out} int, {axis} int, re double, im double")


def _fixed(v: np.ndarray) -> np.ndarray:
    """Columns with the largest component real and positive, so that signs do not depend on the solver."""
    top = v[np.abs(v).round(9).argmax(0), np.arange(v.shape[1])]
    return v * (np.conj(top) / np.maximum(np.abs(top), 1e-300))


def covariance(df: DataFrame, sample: str, channel: str, n: int) -> np.ndarray:
    return to_matrix(channel_gram(df, sample, channel, n).collect(), n)  # n^2 / 2 rows


def singular_values(df: DataFrame, sample: str, channel: str, n: int, count: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors of a tall matrix, from its Gram matrix; ``count`` as for ``dealt``."""
    return _spectrum(channel_gram(df, sample, channel, n, mean=False, count=count), n)


def singular_values_of_tiles(tiles: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``singular_values`` for tiles of n channels each; no row is grouped."""
    return _spectrum(gram_of_tiles(tiles, n, mean=False), n)


def _spectrum(gram: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    w, v = np.linalg.eigh(to_matrix(gram.collect(), n).conj())
    return np.sqrt(np.maximum(w[::-1], 0)), _fixed(v[:, ::-1])


def singular_spectrum(series: DataFrame, rest: Sequence[str], axis: str, window: int, rank: int, remove_mean: bool = True, zero_padding: bool = True) -> DataFrame:
    """Rank-reduced series: the trajectory matrix of all series, its leading right vectors, back-projection, averages over diagonals.

    ``zero_padding`` lets windows reach over both ends, where the series is zero, so every sample counts equally often.
    """
    x = series
    if remove_mean:
        mean = series.groupBy(*rest).agg(F.avg("re").alias("__m"))
        x = series.join(mean, list(rest)).withColumn("re", F.col("re") - F.col("__m")).drop("__m")
    size = series.groupBy(*rest).agg(F.count("*").alias("__n"))
    x = x.join(size, list(rest))
    pad = window - 1 if zero_padding else 0
    h = windows.hankel(x.withColumns({axis: F.col(axis) + pad, "__size": F.col("__n") + 2 * pad}), axis, F.col("__size"), window)
    named = h.withColumn("__key", F.struct(*rest, "p")).withColumn("__row", F.xxhash64(*rest, "p"))
    count = window * (size.agg(F.sum(F.greatest(F.col("__n") + (2 * pad - window + 1), F.lit(0))).alias("n")).first()["n"] or 0)
    _, eof = singular_values(named.select("__row", "w", "re", "im"), "__row", "w", window, count)
    back = apply_channels(named.select("__key", "w", "re", "im"), eof[:, :rank] @ eof[:, :rank].conj().T, "__key", "w", "v", count)
    out = back.select(*(F.col(f"__key.{r}").alias(r) for r in rest), (F.col("__key.p") + F.col("v") - pad).cast("int").alias(axis), "re", "im")
    means = out.groupBy(*rest, axis).agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    return means.join(size, list(rest)).where((F.col(axis) >= 0) & (F.col(axis) < F.col("__n"))).drop("__n")


def coil_compression(df: DataFrame, sample: str, channel: str, n: int, keep: int) -> np.ndarray:
    """(keep, n) matrix onto the leading virtual channels."""
    return singular_values(df, sample, channel, n)[1][:, :keep].T.conj()


def whitening(df: DataFrame, sample: str, channel: str, n: int) -> np.ndarray:
    """Inverse lower Cholesky factor of the covariance."""
    return np.linalg.inv(np.linalg.cholesky(covariance(df, sample, channel, n)))


def region_optimised(pos: np.ndarray, neg: np.ndarray, keep: int) -> np.ndarray:
    """Channel combinations with most signal over interference: a generalised eigenproblem of two Grams."""
    low = np.linalg.inv(np.linalg.cholesky(neg + 1e-9 * np.trace(neg).real / len(neg) * np.eye(len(neg))))
    _, v = np.linalg.eigh(low @ pos @ low.conj().T)
    return _fixed((low.conj().T @ v)[:, ::-1])[:, :keep].T.conj()


def apply_channels(df: DataFrame, m: np.ndarray, sample: str, channel: str, out: str = "v", count: int | None = None) -> DataFrame:
    """m applied over the channels of every sample; m is broadcast (at most MAX_DRIVER_SIDE a side).

    Samples are dealt to as many tasks as the rows need and summed there, so a task holds the sums of a bounded number of rows.
    ``count`` as for ``dealt``.
    """
    return fmac(dealt(df, sample, count=count), matrix_frame(df, m, out, channel), [channel], [sample, out], b_rows=m.size)


def apply_to_tiles(tiles: DataFrame, m: np.ndarray) -> DataFrame:
    """As ``apply_channels`` for tiles that hold all channels of a sample; no row is grouped."""
    return tile_map(tiles, (m.shape[1],), lambda x: x @ m.T)


def dictionary_match(voxels: DataFrame, key: str, frame: str, atoms: np.ndarray) -> DataFrame:
    """Best atom of every voxel: argmax |<atom, voxel>| of unit vectors; ties to the smaller atom."""
    n = atoms.shape[1]
    unit = atoms / np.maximum(np.linalg.norm(atoms, axis=1, keepdims=True), 1e-12)
    g = voxels.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(frame, "re", "im"))).alias("v"))
    flat = g.select(key, F.transform("v", lambda v: v["re"]).alias("re"), F.transform("v", lambda v: v["im"]).alias("im"))

    def best(x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = np.abs(x @ unit.conj().T)
        k = c.round(9).argmax(1)
        return np.stack([k, c[np.arange(len(k)), k]], 1)

    return tile_values(flat, (n,), best, ["atom", "match"])
