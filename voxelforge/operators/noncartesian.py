"""Non-Cartesian encoding with maps and trajectories as tables.

A trajectory row has arrays ``kz``, ``ky``, ``kx`` and ``w``, one entry per sample, in cycles over the field of view; planar
images leave ``kz`` zero.  A map row is a tile (coil, [z,] y, x).  Both are joined on the columns that they have, one per item, label
or study.  Items that share a trajectory share its grid and its transfer function within a batch.

``grid_adjoint`` is the adjoint over cells of samples, which are shuffled in packets.  ``gridded`` is for grids that are wanted as
cells: every sample goes to the cells of its kernel, and sums are taken per task, per salt and in the end per cell, since all
spokes of a radial trajectory hit the centre; it shuffles up to ``salts`` times the grid.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import gridding as G
from ..functions import kernels as K
from ..model import pieces, small_batches
from .joins import small
from .transforms import _lists, tile_map

#: A table and the columns that join it.
Keyed = tuple[DataFrame, Sequence[str]]
ROUTE = ("kz", "ky", "kx", "w")


def _by_trajectory(solve: Callable, image: Sequence[int]) -> Callable:
    """Split a batch by trajectory: ``solve(x, maps, k, w)`` once for each."""

    def run(x: np.ndarray, maps: np.ndarray, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        route = np.stack((far.real, far.imag, near.real, near.imag), 1)
        kinds, own = np.unique(route.reshape(len(x), -1), axis=0, return_inverse=True)
        out = None
        for i in range(len(kinds)):
            at = np.flatnonzero(own.ravel() == i)
            kz, ky, kx, w = route[at[0]]
            k = np.stack((kz, ky, kx)[3 - len(image) :], 1)
            y = solve(x[at], maps[at], k, w)
            out = np.empty((len(x), *y.shape[1:]), complex) if out is None else out
            out[at] = y
        return out

    return run


def _joined(df: DataFrame, maps: Keyed, trajectories: Keyed) -> DataFrame:
    (m, m_on), (t, t_on) = maps, trajectories
    df = df.join(m.select(*m_on, F.col("re").alias("maps_re"), F.col("im").alias("maps_im")), list(m_on))
    return df.join(t.select(*t_on, *ROUTE), list(t_on))


def _apply(df: DataFrame, own: Sequence[int], maps: Keyed, trajectories: Keyed, coils: int, samples: int, image: Sequence[int], solve: Callable) -> DataFrame:
    inputs = [("re", "im"), ("maps_re", "maps_im"), ("kz", "ky"), ("kx", "w")]
    return tile_map(_joined(df, maps, trajectories), None, _by_trajectory(solve, image), inputs, [tuple(own), (coils, *image), (samples,), (samples,)])


def forward(images: DataFrame, maps: Keyed, trajectories: Keyed, coils: int, samples: int, image: Sequence[int], width: int = G.WIDTH) -> DataFrame:
    """Samples (coil, sample) of images: W E S x."""
    return _apply(images, image, maps, trajectories, coils, samples, image, lambda x, m, k, w: w * G.Grid(k, image, width).forward(x[:, None] * m))


def adjoint(data: DataFrame, maps: Keyed, trajectories: Keyed, coils: int, samples: int, image: Sequence[int], width: int = G.WIDTH) -> DataFrame:
    """Images of samples: S^H E^H W y."""
    return _apply(data, (coils, samples), maps, trajectories, coils, samples, image, lambda y, m, k, w: (np.conj(m) * G.Grid(k, image, width).adjoint(w * y)).sum(1))


def normal(images: DataFrame, maps: Keyed, trajectories: Keyed, coils: int, samples: int, image: Sequence[int], width: int = G.WIDTH) -> DataFrame:
    """A^H A x by the circulant form, without any sample."""

    def run(x: np.ndarray, m: np.ndarray, k: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (np.conj(m) * G.Toeplitz(w**2, k, image, width)(x[:, None] * m)).sum(1)

    return _apply(images, image, maps, trajectories, coils, samples, image, run)


def reconstruct(data: DataFrame, maps: Keyed, trajectories: Keyed, coils: int, samples: int, image: Sequence[int], steps: int = 30, lam: float = 0.0, l1: float = 0.0, width: int = G.WIDTH) -> DataFrame:
    """Least squares by conjugate gradients, (A^H A + lam) x = A^H y, or with ``l1`` proximal gradients for |x|_1.

    The samples are gridded once; every step multiplies by the transfer function of the doubled grid.
    """

    def run(y: np.ndarray, m: np.ndarray, k: np.ndarray, w: np.ndarray) -> np.ndarray:
        circular = G.Toeplitz(w**2, k, image, width)
        both = lambda x: (np.conj(m) * circular(x[:, None] * m)).sum(1)
        b = (np.conj(m) * G.Grid(k, image, width).adjoint(w * y)).sum(1)
        if not l1:
            return K.conjugate_gradient(both, b, steps, lam)
        top = np.maximum(K.largest_eigenvalue(both, b), 1e-12).reshape(-1, *[1] * len(image))
        x, ahead, t = np.zeros_like(b), np.zeros_like(b), 1.0
        for _ in range(steps):
            new = ahead - (both(ahead) + lam * ahead - b) / (top + lam)
            new = new * np.maximum(1 - l1 / (top + lam) / np.maximum(np.abs(new), 1e-300), 0)
            nxt = (1 + math.sqrt(1 + 4 * t * t)) / 2
            ahead, x, t = new + (t - 1) / nxt * (new - x), new, nxt
        return x

    return _apply(data, (coils, samples), maps, trajectories, coils, samples, image, run)


def _bessel(x: Column, terms: int = 60) -> Column:
    """I_0 by its power series in (x / 2)^2, from the last term on."""
    scale = [1.0]
    for i in range(1, terms):
        scale.append(scale[-1] / i**2)
    return F.aggregate(F.array(*map(F.lit, scale[::-1])), F.lit(0.0), lambda a, c: a * (x * x / 4) + c)


def neighbours(trajectory: DataFrame, axes: Sequence[str], shape: Sequence[int], width: int = G.WIDTH) -> DataFrame:
    """A row per sample and cell of its kernel: the trajectory's columns, ``g<axis>`` and ``bell``."""
    df = trajectory.withColumn("bell", F.lit(1.0))
    for axis, n in zip(axes, shape, strict=True):
        wide = G.OVER * n
        pos = F.col(axis) * G.OVER + wide // 2
        first = F.ceil(pos - width / 2)
        bell = lambda c, pos=pos: _bessel(F.lit(G.beta(width)) * F.sqrt(F.greatest(F.lit(0.0), 1 - F.pow((pos - c) * 2 / width, F.lit(2.0))))) / width
        each = F.transform(F.sequence(first, first + width - 1), lambda c: F.struct(F.pmod(c, F.lit(wide)).cast("int").alias("c"), bell(c).alias("b")))
        kept = [c for c in df.columns if c != "bell"]
        df = df.select(*kept, "bell", F.explode(each).alias("__e")).select(*kept, F.col("__e.c").alias(f"g{axis}"), (F.col("bell") * F.col("__e.b")).alias("bell"))
    return df


def grid_adjoint(samples: DataFrame, trajectory: Keyed, keys: Sequence[str], axes: Sequence[str], shape: Sequence[int], width: int = G.WIDTH, route_rows: int | None = None) -> DataFrame:
    """Tiles of images from cells of samples (keys, sample columns, re, im) and a trajectory of cells (joined on the given columns).

    A weight column ``w`` of the trajectory multiplies the samples; ``route_rows`` declares its rows, for a broadcast.  Images are
    planes or volumes that fit a task; their samples may be as many as they like.  The samples of a key that meet in a batch are
    shuffled as one packet, or as their own image once they outnumber its cells, so a shuffle carries no grid; a key's packets
    come to a task in order and are added one batch at a time.
    """
    route, on = trajectory
    cells = math.prod(shape)
    small_batches(samples.sparkSession, 16 * cells)
    w = F.col("w") if "w" in route.columns else F.lit(1.0)
    side = route.select(*on, *(F.col(a).cast("double").alias(f"__{a}") for a in axes), w.cast("double").alias("__w"))
    part = lambda c: F.coalesce(F.col(c).cast("double") * F.col("__w"), F.lit(0.0)).alias(c)
    near = samples.join(small(side, route_rows) if route_rows is not None else side, list(on)).select(*keys, *(f"__{a}" for a in axes), part("re"), part("im"))
    near = near.dropna(subset=[f"__{a}" for a in axes])
    places, kept = [f"__{a}" for a in axes], [f for f in near.schema if f.name in keys]
    array = lambda n: T.StructField(n, T.ArrayType(T.DoubleType()))
    form = T.StructType([*kept, *map(array, [*places, "re", "im"])])

    def images(rows: pa.RecordBatch) -> np.ndarray:
        """The images of packets; those that share their positions share a grid."""
        out, alike = np.empty((rows.num_rows, *shape), complex), {}
        at = [rows.column(p) for p in places]
        re, im = rows.column("re"), rows.column("im")
        value = lambda c, i: np.asarray(c[i].values)
        for i in range(rows.num_rows):
            if at[0][i].is_valid:
                k = np.stack([value(c, i) for c in at], 1)
                alike.setdefault(k.tobytes(), (k, []))[1].append(i)
            else:
                out[i] = (value(re, i) + 1j * value(im, i)).reshape(shape)
        for k, own in alike.values():
            out[own] = G.Grid(k, shape, width).adjoint(np.stack([value(re, i) + 1j * value(im, i) for i in own]))
        return out

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.Table.from_batches([batch]).group_by(list(keys), use_threads=False).aggregate([(c, "list") for c in (*places, "re", "im")])
            got = got.select([*(f.name for f in kept), *(f"{c}_list" for c in (*places, "re", "im"))]).rename_columns(form.names).combine_chunks()
            for rows in got.to_batches():
                many = np.diff(rows.column("re").offsets.to_numpy()) > cells
                yield rows.filter(pa.array(~many))
                for i in np.flatnonzero(many):
                    one = rows.slice(i, 1)
                    x, none = images(one), pa.array([None], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*(one.column(f.name) for f in kept), *(none for _ in places), _lists(x.real), _lists(x.imag)], form.names)

    final = T.StructType([*kept, T.StructField("shape", T.ArrayType(T.IntegerType())), array("re"), array("im")])

    def tiles(key: list[pa.Array], x: np.ndarray) -> pa.RecordBatch:
        dims = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(shape), pa.int32()), pa.array(np.tile(np.array(shape, np.int32), len(x))))
        return pa.RecordBatch.from_arrays([*key, dims, _lists(x.real), _lists(x.imag)], final.names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for rows in pieces(batch, 16 * cells):
                names = list(zip(*(rows.column(f.name).to_pylist() for f in kept), strict=True))
                first = [i for i, n in enumerate(names) if not i or n != names[i - 1]]
                x = np.add.reduceat(images(rows), first, 0)
                key = [rows.column(f.name).take(pa.array(first)) for f in kept]
                if last is not None and last[1] == names[0]:
                    x[0] += held[0]
                elif last is not None:
                    yield tiles(last[0], held)
                if len(first) > 1:
                    yield tiles([k.slice(0, len(first) - 1) for k in key], x[:-1])
                last, held = ([k.slice(len(first) - 1) for k in key], names[-1]), x[-1:].copy()
        if last is not None:
            yield tiles(last[0], held)

    packets = near.mapInArrow(gather, form)
    return packets.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, final)


def gridded(samples: DataFrame, trajectory: Keyed, keys: Sequence[str], axes: Sequence[str], shape: Sequence[int], width: int = G.WIDTH, salts: int = 16) -> DataFrame:
    """Cells (keys, g<axis>, re, im) of the oversampled grid: sums in every task, then by salt, then by cell."""
    route, on = trajectory
    w = F.col("w") if "w" in route.columns else F.lit(1.0)
    near = neighbours(route.select(*on, *axes, w.alias("w")), axes, shape, width).select(*on, *(f"g{a}" for a in axes), (F.col("bell") * F.col("w")).alias("bell"))
    cells = [*keys, *(f"g{a}" for a in axes)]
    spread = samples.join(near, list(on)).select(*cells, (F.col("re") * F.col("bell")).alias("re"), (F.col("im") * F.col("bell")).alias("im"), F.pmod(F.hash(*on), F.lit(salts)).alias("__salt"))
    for by in ([*cells, "__salt"], cells):
        spread = spread.groupBy(*by).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return spread
