"""Slicing, padding, shifting, joining and generating cells.  Index work only; values never move together."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import small


def extract(df: DataFrame, block: dict[str, tuple[int, int]]) -> DataFrame:
    """Half-open block per axis, moved to the origin."""
    for axis, (a, b) in block.items():
        df = df.where((F.col(axis) >= a) & (F.col(axis) < b)).withColumn(axis, F.col(axis) - a)
    return df


def embed(df: DataFrame, at: dict[str, int]) -> DataFrame:
    """Adjoint of extract: back to its place, zeros elsewhere are absent."""
    return df.withColumns({axis: F.col(axis) + a for axis, a in at.items()})


def resize(df: DataFrame, sizes: dict[str, tuple[int, int]], anchor: str = "centre") -> DataFrame:
    """Crop or zero-pad axes from size n to m.  Centre keeps n // 2 at m // 2, start the first, front the last cell."""
    if anchor not in ("centre", "start", "front"):
        raise ValueError(anchor)
    for axis, (n, m) in sizes.items():
        move = {"centre": m // 2 - n // 2, "start": 0, "front": m - n}[anchor]
        df = df.withColumn(axis, F.col(axis) + move).where((F.col(axis) >= 0) & (F.col(axis) < m))
    return df


def source_index(target: Column, n: int, mode: str) -> Column:
    """Index below n that a padded position (relative to the start) takes its value from."""
    if mode == "wrap":
        return F.pmod(target, F.lit(n))
    if mode == "symmetric":
        p = F.pmod(target, F.lit(2 * n))
        return F.when(p < n, p).otherwise(2 * n - 1 - p)
    if mode == "reflect":
        if n == 1:
            return target * 0
        p = F.pmod(target, F.lit(2 * n - 2))
        return F.when(p < n, p).otherwise(2 * n - 2 - p)
    raise ValueError(mode)


def pad(df: DataFrame, axis: str, n: int, before: int, after: int, mode: str = "constant") -> DataFrame:
    """Pad an axis; every cell is copied to its targets, found by a join with the axis's index map."""
    if before < 0 or after < 0:
        raise ValueError("sizes must not be negative")
    if mode == "constant":
        return df.withColumn(axis, F.col(axis) + before)
    t = df.sparkSession.range(before + n + after).select(F.col("id").cast("int").alias("__t"))
    t = t.withColumn("__s", source_index(F.col("__t") - before, n, mode).cast("int"))
    return df.join(small(t, before + n + after), F.col(axis) == F.col("__s")).withColumn(axis, F.col("__t")).drop("__t", "__s")


def flip(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    return df.withColumns({a: n - 1 - F.col(a) for a, n in sizes.items()})


def roll(df: DataFrame, axis: str, n: int, shift: int, wrap: bool = True) -> DataFrame:
    """i -> i + shift, modulo n or dropping what leaves."""
    if wrap:
        return df.withColumn(axis, F.pmod(F.col(axis) + shift, F.lit(n)))
    return df.withColumn(axis, F.col(axis) + shift).where((F.col(axis) >= 0) & (F.col(axis) < n))


def fft_shift(df: DataFrame, sizes: dict[str, int], inverse: bool = False) -> DataFrame:
    for a, n in sizes.items():
        df = roll(df, a, n, n - n // 2 if inverse else n // 2)
    return df


def transpose(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumnsRenamed({a: "__t"}).withColumnsRenamed({b: a}).withColumnsRenamed({"__t": b})


def repeat(df: DataFrame, axis: str, n: int) -> DataFrame:
    return df.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def concatenate(parts: Sequence[tuple[DataFrame, int]], axis: str) -> DataFrame:
    """(cells, size) end to end along an axis."""
    out, at = None, 0
    for df, n in parts:
        moved = df.withColumn(axis, F.col(axis) + at)
        out = moved if out is None else out.unionByName(moved)
        at += n
    return out


def stack(parts: Sequence[DataFrame], axis: str) -> DataFrame:
    """A new axis numbers the parts."""
    out = None
    for i, df in enumerate(parts):
        one = df.withColumn(axis, F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def add_parts(parts: Sequence[DataFrame], axes: Sequence[str]) -> DataFrame:
    """Sum of several tables of cells."""
    out = parts[0].select(*axes, "re", "im")
    for df in parts[1:]:
        out = out.unionByName(df.select(*axes, "re", "im"))
    return out.groupBy(*axes).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def add_to_tiles(tiles: DataFrame, constant: DataFrame, factor: float = 1.0) -> DataFrame:
    """factor * tile + the one tile of ``constant``, which is broadcast: no row is grouped, absent values are zero."""
    one = constant.select(F.col("re").alias("__r"), F.col("im").alias("__i"))
    value = lambda v: F.coalesce(v, F.lit(0.0))
    add = lambda c, k: F.zip_with(c, k, lambda u, v: value(u) * factor + value(v))
    return tiles.crossJoin(F.broadcast(one)).withColumns({"re": add("re", "__r"), "im": add("im", "__i")}).drop("__r", "__i")  # one row


def overlay(base: DataFrame, block: DataFrame, axes: Sequence[str]) -> DataFrame:
    """The block's cells replace those of base."""
    b = block.select(*axes, F.col("re").alias("__r"), F.col("im").alias("__i"))
    return base.select(*axes, "re", "im").join(b, list(axes), "full").select(*axes, F.coalesce("__r", "re").alias("re"), F.coalesce("__i", "im").alias("im"))


def compress(df: DataFrame, mask: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Only cells where the mask is not zero."""
    return df.join(mask.where("re <> 0").select(*axes), list(axes), "left_semi")


def expand(df: DataFrame, mask: DataFrame, axes: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """Adjoint of ``compress``: a cell wherever the mask is not zero, zero where the compressed cells have none."""
    m = mask.where("re <> 0").select(*axes)
    return m.join(df, list(axes), "left").select(*axes, *kept, F.coalesce("re", F.lit(0.0)).alias("re"), F.coalesce("im", F.lit(0.0)).alias("im"))


def block_diagonal(parts: Sequence[tuple[DataFrame, int, Callable[[DataFrame], DataFrame], int]], axis: str) -> DataFrame:
    """Operators on parts of their own, results end to end: (cells, _, operator, size of its result)."""
    return concatenate([(fn(df), n) for df, _, fn, n in parts], axis)


def block_row(parts: Sequence[tuple[DataFrame, Callable[[DataFrame], DataFrame]]], axes: Sequence[str]) -> DataFrame:
    """Operators side by side: their results add up."""
    return add_parts([fn(df) for df, fn in parts], axes)


def block_matrix(rows: Sequence[tuple[Sequence[Callable[[DataFrame], DataFrame] | None], int]], parts: Sequence[DataFrame], axes: Sequence[str], axis: str) -> DataFrame:
    """A matrix of operators (None is zero): each row adds up over the parts, rows lie end to end; (operators, size of the row's result)."""
    return concatenate([(block_row([(p, fn) for p, fn in zip(parts, ops, strict=True) if fn is not None], axes), n) for ops, n in rows], axis)


def full(spark: SparkSession, sizes: dict[str, int], value: complex = 1.0) -> DataFrame:
    """A constant array: a cell for every position."""
    df = spark.range(math.prod(sizes.values()))
    step = 1
    for axis, n in reversed(sizes.items()):
        df = df.withColumn(axis, F.pmod(F.floor(F.col("id") / step), F.lit(n)).cast("int"))
        step *= n
    v = complex(value)
    return df.select(*sizes, F.lit(v.real).alias("re"), F.lit(v.imag).alias("im"))


def ones(spark: SparkSession, sizes: dict[str, int]) -> DataFrame:
    return full(spark, sizes)


def zeros(spark: SparkSession, sizes: dict[str, int]) -> DataFrame:
    """Cells that say zero; an absent cell means the same."""
    return full(spark, sizes, 0.0)


def vector(spark: SparkSession, values: Sequence[complex], axis: str = "i") -> DataFrame:
    """Listed values along one axis."""
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias(axis), F.lit(complex(v).real).alias("re"), F.lit(complex(v).imag).alias("im")) for i, v in enumerate(values))))
    return spark.range(1).select(rows.alias("v")).select("v.*")


def delta(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """1 where all the axes of a cell agree, else 0."""
    same = F.lit(True)
    for a in axes[1:]:
        same = same & (F.col(a) == F.col(axes[0]))
    return df.withColumns({"re": same.cast("double"), "im": F.lit(0.0)})


def index(spark: SparkSession, n: int, low: float | None = None, high: float | None = None, log: bool = False) -> DataFrame:
    """0..n-1, or n values from low to high, evenly or by a constant factor."""
    df = spark.range(n).select(F.col("id").cast("int").alias("i"))
    if low is None:
        return df.select("i", F.col("i").cast("double").alias("re"), F.lit(0.0).alias("im"))
    t = F.col("i") / max(1, n - 1)
    v = F.exp(math.log(low) + t * math.log(high / low)) if log else low + t * (high - low)
    return df.select("i", v.alias("re"), F.lit(0.0).alias("im"))


def grid(df: DataFrame, sizes: dict[str, int], kspace: bool = False, time: tuple[str, float, float] | None = None) -> DataFrame:
    """Coordinates i - n // 2 of every cell, in units of the field of view unless ``kspace``; time: (axis, start, step)."""
    out = {f"p{a}": (F.col(a) - n // 2) / (1.0 if kspace else float(n)) for a, n in sizes.items()}
    if time is not None:
        out[f"p{time[0]}"] = F.lit(float(time[1])) + F.col(time[0]) * float(time[2])
    return df.withColumns(out)


def polynomial(df: DataFrame, x: str, coefficients: Sequence[float]) -> DataFrame:
    """Sum of a_k x^k by Horner's rule."""
    v = F.aggregate(F.array(*(F.lit(float(c)) for c in reversed(coefficients))), F.lit(0.0), lambda s, c: s * F.col(x) + c)
    return df.withColumns({"re": v, "im": F.lit(0.0)})


def cartesian(lines: DataFrame, line: str, n: int, samples: int) -> DataFrame:
    """Coordinates (kx, ky) in grid units of readouts along x, line by line."""
    out = lines.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return out.withColumns({"kx": F.col("sample") - float(samples // 2), "ky": F.col(line) - float(n // 2)})


def radial(spokes: DataFrame, spoke: str, n: int, samples: int, golden: bool = False, full_circle: bool = False, oversampling: float = 1.0, half_sample: bool = False) -> DataFrame:
    """Coordinates (kx, ky) in grid units of radial spokes, even (over half or the full circle) or by the golden angle.

    ``oversampling`` divides the step between samples; ``half_sample`` moves them by half a step, so that
    they are symmetric about zero.
    """
    t = F.col(spoke) * (math.pi * (math.sqrt(5) - 1) / 2 if golden else (2 if full_circle else 1) * math.pi / n)
    r = (F.col("sample") - samples / 2 + (0.5 if half_sample else 0.0)) / oversampling
    return spokes.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumns({"kx": r * F.cos(t), "ky": r * F.sin(t)})


def undersample(df: DataFrame, y: tuple[str, int, int], z: tuple[str, int, int], centre: int) -> DataFrame:
    """Keep every y-th and z-th line, and all lines of the centre; (axis, size, factor)."""
    (ay, ny, fy), (az, nz, fz) = y, z
    mid = lambda a, n: (F.col(a) >= n // 2 - centre // 2) & (F.col(a) < n // 2 - centre // 2 + centre)
    return df.where(((F.col(ay) % fy == 0) & (F.col(az) % fz == 0)) | (mid(ay, ny) & mid(az, nz)))


def sampled(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """1 where any cell over the other axes is not zero."""
    return df.groupBy(*axes).agg(F.max(((F.col("re") != 0) | (F.col("im") != 0)).cast("double")).alias("re")).withColumn("im", F.lit(0.0))


def one_hot(df: DataFrame, label: str, n: int) -> DataFrame:
    return df.withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"re": (F.col(label) == F.col("cls")).cast("double"), "im": F.lit(0.0)})


def add_noise(df: DataFrame, variance: float, seed: int) -> DataFrame:
    """Add complex Gaussian noise whose two parts have half the variance each."""
    s = math.sqrt(variance / 2)
    return df.withColumns({"re": F.col("re") + s * F.randn(seed), "im": F.col("im") + s * F.randn(seed + 1)})
