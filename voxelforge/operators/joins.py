"""Broadcasting products, gathers, scatters and interpolation as equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast; both sides shuffle beyond it.
BROADCAST_CELLS = 1_000_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side whose declared number of rows is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_CELLS else df


def fmac(a: DataFrame, b: DataFrame, shared: Sequence[str], kept: Sequence[str], conjugate: bool = False, b_rows: int | None = None) -> DataFrame:
    """Sum over the axes not kept of a * b (or a * conj(b)), b broadcast over the axes it lacks."""
    b = b.withColumnsRenamed({"re": "br", "im": "bi"})
    j = a.join(small(b, b_rows) if b_rows is not None else b, list(shared))
    s = -1.0 if conjugate else 1.0
    re, im = F.col("re") * F.col("br") - s * F.col("im") * F.col("bi"), F.col("im") * F.col("br") + s * F.col("re") * F.col("bi")
    return j.groupBy(*kept).agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def diagonal(df: DataFrame, weights: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Pointwise product with a diagonal that has only ``axes``; absent weights are zero and drop the cell."""
    w = weights.withColumnsRenamed({"re": "__r", "im": "__i"})
    out = {"re": F.col("re") * F.col("__r") - F.col("im") * F.col("__i"), "im": F.col("re") * F.col("__i") + F.col("im") * F.col("__r")}
    return df.join(w, list(axes)).withColumns(out).drop("__r", "__i")


def gather(cells: DataFrame, positions: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Cells at the listed positions (extra columns say where they go); negative positions are padding."""
    ok = positions
    for a in axes:
        ok = ok.where(F.col(a) >= 0)
    return ok.join(cells, list(axes))


def scatter(samples: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Adjoint of gather: samples of the same cell add up."""
    return samples.groupBy(*axes).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def data_consistency(x: DataFrame, y: DataFrame, axes: Sequence[str], robust: float | None = None) -> DataFrame:
    """Measured cells of y win, others keep the iterate x.

    ``robust``: x plus the residual y - x soft-thresholded by it, so that small differences stay.
    """
    m = y.select(*axes, F.col("re").alias("__r"), F.col("im").alias("__i"))
    both = x.join(m, list(axes), "left")
    if robust is None:
        return both.withColumns({"re": F.coalesce("__r", "re"), "im": F.coalesce("__i", "im")}).drop("__r", "__i")
    dr, di = F.coalesce(F.col("__r") - F.col("re"), F.lit(0.0)), F.coalesce(F.col("__i") - F.col("im"), F.lit(0.0))
    size = F.sqrt(dr * dr + di * di)
    f = F.when(size > robust, 1 - robust / size).otherwise(0.0)
    return both.withColumns({"re": F.col("re") + f * dr, "im": F.col("im") + f * di}).drop("__r", "__i")


def apply_matrix(df: DataFrame, matrix: DataFrame, axis: str, out: str, kept: Sequence[str]) -> DataFrame:
    """out[o] = sum over axis of matrix[o, axis] * x[axis]."""
    return fmac(df, matrix, [axis], [*kept, out])


def _keys_weight(d: Column) -> Column:
    """Cubic convolution kernel with a = -1/2."""
    d = F.abs(d)
    return F.when(d <= 1, 1.5 * d * d * d - 2.5 * d * d + 1).when(d < 2, -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2).otherwise(0.0)


def interpolate(cells: DataFrame, coords: DataFrame, axes: Sequence[tuple[str, str, int]], out: Sequence[str], order: int = 1, batch: Sequence[str] = ()) -> DataFrame:
    """Values at coordinates; axes are (cell axis, coordinate column, size).

    Every coordinate names its neighbours, so the range join is an equi-join.  Zero outside [0, n - 1].
    Order 0 rounds half up, 1 is linear, 3 the cubic kernel (neighbours outside are zero).
    """
    w = F.lit(1.0)
    q = coords
    for axis, c, n in axes:
        q = q.where((F.col(c) >= 0) & (F.col(c) <= n - 1))
        base = F.floor(F.col(c) + (0.5 if order == 0 else 0.0)).cast("int")
        steps = {0: [0], 1: [0, 1], 3: [-1, 0, 1, 2]}[order]
        q = q.withColumn(axis, F.explode(F.array(*(base + s for s in steps)))).where((F.col(axis) >= 0) & (F.col(axis) < n))
        d = F.col(c) - F.col(axis)
        w = w * (F.lit(1.0) if order == 0 else 1 - F.abs(d) if order == 1 else _keys_weight(d))
    q = q.withColumn("__w", w).where("__w <> 0")
    j = q.join(cells.select(*batch, *(a for a, _, _ in axes), "re", "im"), [*batch, *(a for a, _, _ in axes)])
    return j.groupBy(*batch, *out).agg(F.sum(F.col("re") * F.col("__w")).alias("re"), F.sum(F.col("im") * F.col("__w")).alias("im"))


def warp(cells: DataFrame, displacement: DataFrame, axes: Sequence[tuple[str, str, int]], order: int = 1, batch: Sequence[str] = ()) -> DataFrame:
    """out[p] = x(p + d[p]); displacement has the axes p and a column per axis."""
    out = [f"o_{a}" for a, _, _ in axes]
    q = displacement.withColumns({c: F.col(c) + F.col(a) for a, c, _ in axes}).withColumnsRenamed({a: f"o_{a}" for a, _, _ in axes})
    return interpolate(cells, q, axes, out, order, batch).withColumnsRenamed({o: o[2:] for o in out})


def affine(cells: DataFrame, grid: DataFrame, matrix: Sequence[Sequence[float]], axes: Sequence[tuple[str, str, int]], order: int = 1, batch: Sequence[str] = ()) -> DataFrame:
    """out(u) = x(M [u, 1]) in units of the field of view, u = (p - n // 2) / n; grid lists the output cells."""
    n_ax = len(axes)
    if n_ax not in (2, 3) or (len(matrix) == n_ax + 1 and list(matrix[-1]) != [0.0] * n_ax + [1.0]):
        raise ValueError("two or three axes, and a unit homogeneous row")
    u = [(F.col(a) - n // 2) / float(n) for a, _, n in axes]
    coords = {c: (sum((matrix[i][j] * u[j] for j in range(n_ax)), F.lit(float(matrix[i][n_ax])))) * n + n // 2 for i, (_, c, n) in enumerate(axes)}
    out = [f"o_{a}" for a, _, _ in axes]
    q = grid.withColumns(coords).withColumnsRenamed({a: f"o_{a}" for a, _, _ in axes})
    return interpolate(cells, q, axes, out, order, batch).withColumnsRenamed({o: o[2:] for o in out})
