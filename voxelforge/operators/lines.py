"""Transforms of arrays that exceed a tile: an axis at a time, one shuffle for each.

A line along an axis is gathered, transformed in a batch of lines and dissolved again.  A line of more than
``most`` values is never gathered: its length is split in two factors, n = a b.  Position j = b j1 + j2 is
transformed over j1 with j2 held, turned by exp(-+2 pi i j2 k1 / n) and transformed over j2, which
gives the frequency k1 + a k2; both factors are shorter axes, split again where they need to be.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..model import cells_to_tiles, tiles_to_cells
from .transforms import tile_map

#: Values of a line that a task gathers.
LINE = 1 << 20


def split(n: int, most: int) -> int:
    """The largest factor of n that is at most ``most``, and not n itself."""
    best = max((f for i in range(1, math.isqrt(n) + 1) if n % i == 0 for f in (i, n // i) if f <= most and f < n), default=1)
    if best == 1:
        raise ValueError(f"{n} has no factor between 2 and {most}")
    return best


def fft_axis(cells: DataFrame, axis: str, n: int, inverse: bool = False, unitary: bool = False, centred: bool = True, most: int = LINE) -> DataFrame:
    """Transform along one axis of cells (any other columns, axis, re, im); absent cells are zero."""
    rest = [c for c in cells.columns if c not in (axis, "re", "im")]
    if n <= most:
        lines = cells_to_tiles(cells, rest, [axis], [n])
        done = tile_map(lines, (n,), lambda x: K.fft(x, (1,), inverse, unitary, centred))
        return tiles_to_cells(done, [axis], [n]).select(*cells.columns)
    a = split(n, most)
    b, middle = n // a, n // 2 if centred else 0
    at = F.pmod(F.col(axis) - middle, F.lit(n))
    two = cells.select(*rest, F.floor(at / b).cast("int").alias(f"{axis}_1"), (at % b).cast("int").alias(f"{axis}_2"), "re", "im")
    first = fft_axis(two, f"{axis}_1", a, inverse, unitary, False, most)
    angle = F.col(f"{axis}_1") * F.col(f"{axis}_2") * ((2 if inverse else -2) * math.pi / n)
    re, im = F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle), F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)
    second = fft_axis(first.withColumns({"re": re, "im": im}), f"{axis}_2", b, inverse, unitary, False, most)
    back = F.pmod(F.col(f"{axis}_1") + a * F.col(f"{axis}_2") + middle, F.lit(n)).cast("int")
    return second.withColumn(axis, back).select(*cells.columns)


def fft(cells: DataFrame, sizes: Mapping[str, int], inverse: bool = False, unitary: bool = False, centred: bool = True, most: int = LINE) -> DataFrame:
    """Transform over all axes named in ``sizes``."""
    for axis, n in sizes.items():
        cells = fft_axis(cells, axis, n, inverse, unitary, centred, most)
    return cells
