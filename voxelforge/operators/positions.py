"""Encoding with sampled positions and a temporal basis: whole readouts are gathered from, and added into, the lines of k-space.

A positions row holds ``lines``, frames x shots entries, frame by frame: the line that a shot reads, or a negative number for padding.
Positions and maps are tables joined on the columns that they have, so every item, label or study may have its own.
For coefficient images x_a with the basis B (a, t):  y[t, s, coil] = line lines[t, s] of  F S_coil sum_a B[a, t] x_a.
The normal operator needs no samples: a line l is weighted by the kernel sum_t n[t, l] conj(B[a, t]) B[d, t], n counting its shots.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .transforms import tile_map

Keyed = tuple[DataFrame, Sequence[str]]


def forward_lines(x: np.ndarray, maps: np.ndarray, lines: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """(item, t, s, coil, x) of coefficient images (item, a, y, x); lines (item, t, s)."""
    spectra = K.fft(x[:, :, None] * maps[:, None], (-2, -1), unitary=True)  # item, a, coil, y, x
    some = spectra.transpose(0, 3, 1, 2, 4)[np.arange(len(x))[:, None, None], np.maximum(lines, 0)]
    return np.einsum("at,btsacx->btscx", basis, some) * (lines >= 0)[..., None, None]


def adjoint_lines(y: np.ndarray, maps: np.ndarray, lines: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Adjoint of ``forward_lines``: shots of the same line add up."""
    each = np.einsum("at,btscx->btsacx", np.conj(basis), y * (lines >= 0)[..., None, None])
    spectra = np.zeros((len(y), maps.shape[2], *each.shape[3:]), complex)
    np.add.at(spectra, (np.arange(len(y))[:, None, None], np.maximum(lines, 0)), each)
    image = K.fft(spectra.transpose(0, 2, 3, 1, 4), (-2, -1), inverse=True, unitary=True)
    return (np.conj(maps)[:, None] * image).sum(2)


def line_kernel(lines: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """(item, a, d, line)."""
    count = (lines[..., None] == np.arange(n)).sum(2)
    return np.einsum("at,btl,dt->badl", np.conj(basis), count, basis)


def normal_lines(x: np.ndarray, maps: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    mixed = np.einsum("badl,bdclx->baclx", kernel, K.fft(x[:, :, None] * maps[:, None], (-2, -1), unitary=True))
    return (np.conj(maps)[:, None] * K.fft(mixed, (-2, -1), inverse=True, unitary=True)).sum(2)


def _apply(df: DataFrame, own: Sequence[int], maps: Keyed, positions: Keyed, basis: np.ndarray, shots: int, coils: int, image: Sequence[int], solve: Callable) -> DataFrame:
    (m, m_on), (p, p_on) = maps, positions
    df = df.join(m.select(*m_on, F.col("re").alias("maps_re"), F.col("im").alias("maps_im")), list(m_on))
    df = df.join(p.select(*p_on, F.transform("lines", lambda v: v.cast("double")).alias("lines")).withColumn("none", F.transform("lines", lambda v: v * 0)), list(p_on))
    run = lambda x, maps, lines: solve(x, maps, lines.real.astype(int))
    return tile_map(df, None, run, [("re", "im"), ("maps_re", "maps_im"), ("lines", "none")], [tuple(own), (coils, *image), (basis.shape[1], shots)])


def forward(images: DataFrame, maps: Keyed, positions: Keyed, basis: np.ndarray, shots: int, coils: int, image: Sequence[int]) -> DataFrame:
    """Readouts (t, s, coil, x) of coefficient images (a, y, x)."""
    return _apply(images, (len(basis), *image), maps, positions, basis, shots, coils, image, lambda x, m, p: forward_lines(x, m, p, basis))


def adjoint(readouts: DataFrame, maps: Keyed, positions: Keyed, basis: np.ndarray, shots: int, coils: int, image: Sequence[int]) -> DataFrame:
    """Coefficient images of readouts."""
    own = (basis.shape[1], shots, coils, image[1])
    return _apply(readouts, own, maps, positions, basis, shots, coils, image, lambda y, m, p: adjoint_lines(y, m, p, basis))


def reconstruct(readouts: DataFrame, maps: Keyed, positions: Keyed, basis: np.ndarray, shots: int, coils: int, image: Sequence[int], steps: int = 30, lam: float = 0.0) -> DataFrame:
    """Least squares coefficients, steps by the kernel of the lines."""

    def solve(y: np.ndarray, m: np.ndarray, p: np.ndarray) -> np.ndarray:
        kernel = line_kernel(p, basis, image[0])
        return K.conjugate_gradient(lambda x: normal_lines(x, m, kernel), adjoint_lines(y, m, p, basis), steps, lam)

    own = (basis.shape[1], shots, coils, image[1])
    return _apply(readouts, own, maps, positions, basis, shots, coils, image, solve)
