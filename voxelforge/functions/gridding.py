"""Non-uniform transforms over any number of axes: Kaiser-Bessel gridding and the circulant normal operator.

Positions k are (samples, axes) in cycles over the field of view, images are centred:
y_j = N^-1/2 sum_m x_m exp(-2 pi i k_j (m - n // 2) / n).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

WIDTH, OVER = 8, 2


def beta(width: int, over: float = OVER) -> float:
    """Shape of the kernel for a width in cells of the oversampled grid."""
    return math.pi * math.sqrt((width / over) ** 2 * (over - 0.5) ** 2 - 0.8)


def roll_off(n: int, width: int, over: int = OVER) -> np.ndarray:
    """Transform of the kernel at the n central positions of the oversampled image."""
    z = np.sqrt((beta(width, over) ** 2 - (math.pi * width * (np.arange(n) - n // 2) / (over * n)) ** 2).astype(complex))
    return (np.sinh(z) / z).real


class Grid:
    """Samples at fixed positions against a grid of ``over`` times the image."""

    def __init__(self, k: np.ndarray, shape: Sequence[int], width: int = WIDTH, over: int = OVER):
        self.shape, self.wide = tuple(shape), tuple(over * n for n in shape)
        at, weight = np.zeros((len(k), 1), np.int64), np.ones((len(k), 1))
        for i, n in enumerate(self.wide):
            pos = k[:, i] * over + n // 2
            first = np.ceil(pos - width / 2).astype(np.int64)
            cell = first[:, None] + np.arange(width)
            bell = np.i0(beta(width, over) * np.sqrt(np.maximum(0, 1 - (2 * (pos[:, None] - cell) / width) ** 2))) / width
            at = (at[:, :, None] * n + (cell % n)[:, None, :]).reshape(len(k), -1)
            weight = (weight[:, :, None] * bell[:, None, :]).reshape(len(k), -1)
        self.at, self.weight = at, weight
        self.box = tuple(slice(w // 2 - n // 2, w // 2 - n // 2 + n) for n, w in zip(self.shape, self.wide, strict=True))
        scale = np.ones(())
        for n in self.shape:
            scale = np.multiply.outer(scale, 1 / roll_off(n, width, over))
        self.scale = scale / math.sqrt(math.prod(self.shape))

    def _axes(self, x: np.ndarray) -> tuple[int, ...]:
        return tuple(range(x.ndim - len(self.shape), x.ndim))

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Samples (..., sample) of images (..., *shape)."""
        wide = np.zeros((*x.shape[: x.ndim - len(self.shape)], *self.wide), complex)
        wide[(..., *self.box)] = x * self.scale
        axes = self._axes(x)
        spectrum = np.fft.fftshift(np.fft.fftn(np.fft.ifftshift(wide, axes), axes=axes), axes).reshape(*x.shape[: axes[0]], -1)
        return (spectrum[..., self.at] * self.weight).sum(-1)

    def adjoint(self, y: np.ndarray) -> np.ndarray:
        """Images (..., *shape) of samples (..., sample)."""
        flat, size = y.reshape(-1, y.shape[-1]), math.prod(self.wide)
        grid = np.empty((len(flat), size), complex)
        for i, v in enumerate(flat):
            spread = v[:, None] * self.weight
            grid[i] = np.bincount(self.at.ravel(), spread.real.ravel(), size) + 1j * np.bincount(self.at.ravel(), spread.imag.ravel(), size)
        grid = grid.reshape(*y.shape[:-1], *self.wide)
        axes = self._axes(grid)
        wide = np.fft.fftshift(np.fft.ifftn(np.fft.ifftshift(grid, axes), axes=axes), axes) * size
        return wide[(..., *self.box)] * self.scale


def point_spread(weights: np.ndarray, k: np.ndarray, shape: Sequence[int], width: int = WIDTH) -> np.ndarray:
    """h(m) = 1 / N sum_j w_j exp(2 pi i k_j m / n) for m from -n to n - 1 on every axis."""
    double = tuple(2 * n for n in shape)
    return Grid(2 * k, double, width).adjoint(weights.astype(complex)) * math.sqrt(math.prod(double)) / math.prod(shape)


class Toeplitz:
    """x -> sum over j of w_j E_j^H E_j x: a convolution with the point spread, made circular on the doubled grid."""

    def __init__(self, weights: np.ndarray, k: np.ndarray, shape: Sequence[int], width: int = WIDTH):
        self.shape = tuple(shape)
        self.axes = tuple(range(-len(shape), 0))
        self.transfer = np.fft.fftn(np.fft.ifftshift(point_spread(weights, k, shape, width), self.axes), axes=self.axes)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        double = [2 * n for n in self.shape]
        wide = np.fft.ifftn(self.transfer * np.fft.fftn(x, double, axes=self.axes), axes=self.axes)
        return wide[(..., *(slice(0, n) for n in self.shape))]
