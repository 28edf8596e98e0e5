"""Coil sensitivities from k-space tiles (coil, y, x); every function gives tiles of maps, one row per item."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from ..functions import kernels as K
from .transforms import tile_map


def _centre(n: int, size: int) -> slice:
    return slice(n // 2 - size // 2, n // 2 - size // 2 + size)


def caldir(kspace: DataFrame, size: int, shape: Sequence[int] | None = None) -> DataFrame:
    """Low-resolution coil images from the centre of k-space, over their root of sums of squares."""

    def maps(y: np.ndarray) -> np.ndarray:
        low, box = np.zeros_like(y), (..., _centre(y.shape[2], size), _centre(y.shape[3], size))
        low[box] = y[box]
        im = K.fft(low, (2, 3), inverse=True, unitary=True)
        return im / np.maximum(np.sqrt((np.abs(im) ** 2).sum(1, keepdims=True)), 1e-12)

    return tile_map(kspace, shape, maps)


def walsh(kspace: DataFrame, block: int = 3, shape: Sequence[int] | None = None) -> DataFrame:
    """Leading eigenvector of the coil covariance summed over a block around every voxel (cut off at the edge)."""

    def maps(y: np.ndarray) -> np.ndarray:
        im = K.fft(y, (2, 3), inverse=True, unitary=True)
        c = np.einsum("baij,bcij->bijac", im, np.conj(im))
        r = block // 2
        wide = np.pad(c, ((0, 0), (r, r), (r, r), (0, 0), (0, 0)))
        ny, nx = y.shape[2:]
        return np.moveaxis(K.dominant(sum(wide[:, p : p + ny, q : q + nx] for p in range(block) for q in range(block)))[1], -1, 1)

    return tile_map(kspace, shape, maps)


def ecalib(kspace: DataFrame, kernel: int = 3, threshold: float = 0.02, crop: float = 0.8, calibration: int | None = None, sets: int = 1, soft_weight: bool = False, shape: Sequence[int] | None = None) -> DataFrame:
    """Eigenvector maps; tiles of (coil, y, x), or (set, coil, y, x) for several sets."""

    def maps(y: np.ndarray) -> np.ndarray:
        out = np.stack([K.espirit(k, kernel, threshold, crop, calibration, sets, soft_weight) for k in y])
        return out[:, 0] if sets == 1 else out

    return tile_map(kspace, shape, maps)


def maps_to_kernels(maps: DataFrame, size: int, shape: Sequence[int] | None = None) -> DataFrame:
    """The centre of the unitary spectrum over the last two axes."""

    def crop(x: np.ndarray) -> np.ndarray:
        return K.fft(x, (-2, -1), unitary=True)[..., _centre(x.shape[-2], size), _centre(x.shape[-1], size)]

    return tile_map(maps, shape, crop)


def kernels_to_maps(kernels: DataFrame, image: tuple[int, int], shape: Sequence[int] | None = None) -> DataFrame:
    """Zeros around the kernels, then the inverse transform."""

    def back(k: np.ndarray) -> np.ndarray:
        wide = np.zeros((*k.shape[:-2], *image), complex)
        wide[..., _centre(image[0], k.shape[-2]), _centre(image[1], k.shape[-1])] = k
        return K.fft(wide, (-2, -1), inverse=True, unitary=True)

    return tile_map(kernels, shape, back)
