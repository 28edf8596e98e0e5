"""Reconstruction with any list of penalties: consensus splitting over pairs of a transform and a proximal map.

    minimise 1/2 |A x - y|^2 + sum_i f_i(T_i x)

Every term has a copy z_i of T_i x and a scaled dual of its own.  A step solves
(A^H A + rho sum_i T_i^H T_i) x = A^H y + rho sum_i T_i^H (z_i - w_i) by conjugate gradients and applies the proximal maps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..functions import kernels as K
from .recon import Side, encoded, normal_of
from .transforms import tile_map

Map = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Term:
    """A transform with its adjoint, the proximal map of rate times the penalty, and the penalty of every item."""

    forward: Map
    adjoint: Map
    prox: Callable[[np.ndarray, float], np.ndarray]
    value: Map


def _same(x: np.ndarray) -> np.ndarray:
    return x


def _each(f: Map) -> Map:
    return lambda v: f(v).reshape(len(v), -1).sum(1)


def l1(lam: float, forward: Map = _same, adjoint: Map = _same) -> Term:
    """lam times the sum of magnitudes of a transform."""
    return Term(forward, adjoint, lambda v, rate: K.soft(v, lam * rate), _each(lambda v: lam * np.abs(v)))


def total_variation(lam: float) -> Term:
    """Differences along the last two axes, each for itself."""
    flat = lambda x: x.reshape(-1, *x.shape[-2:])
    return l1(lam, lambda x: K.grad(flat(x)).reshape(*x.shape[:-2], 2, *x.shape[-2:]), lambda g: K.grad_adjoint(g.reshape(-1, *g.shape[-3:])).reshape(*g.shape[:-3], *g.shape[-2:]))


def laplace(lam: float) -> Term:
    """The circular Laplacian over the last two axes."""
    both = lambda x: sum(np.roll(x, s, a) for a in (-2, -1) for s in (-1, 1)) - 4 * x
    return l1(lam, both, both)


def fourier(lam: float) -> Term:
    """The unitary spectrum over the last two axes."""
    return l1(lam, lambda x: K.fft(x, (-2, -1), unitary=True), lambda x: K.fft(x, (-2, -1), inverse=True, unitary=True))


def wavelet(lam: float, name: str = "dau2") -> Term:
    """Wavelet coefficients, thresholded inside the proximal map."""

    def value(x: np.ndarray) -> np.ndarray:
        return lam * np.abs(K.fwt(x, (-2, -1), name)).reshape(len(x), -1).sum(1)

    return Term(_same, _same, lambda v, rate: K.wavelet_soft(v, lam * rate, name), value)


def low_rank(lam: float, size: int) -> Term:
    """lam times the singular values of every block over the leading axis: all blocks of a batch in one decomposition."""

    def prox(v: np.ndarray, rate: float) -> np.ndarray:
        u, s, w = np.linalg.svd(K.blocks(v, size), full_matrices=False)
        return K.unblocked((u * np.maximum(s - lam * rate, 0)[..., None, :]) @ w, size, v.shape[-2:])

    return Term(_same, _same, prox, lambda v: lam * np.linalg.svd(K.blocks(v, size), compute_uv=False).sum((1, 2)))


def split(normal: Map, right: np.ndarray, terms: Sequence[Term], rho: float, steps: int, inner: int = 8) -> np.ndarray:
    """The consensus iteration on a batch; without terms it is least squares."""
    if not terms:
        return K.conjugate_gradient(normal, right, steps * inner)
    x = right
    z = [np.zeros_like(t.forward(x)) for t in terms]
    w = [np.zeros_like(v) for v in z]
    both = lambda v: normal(v) + rho * sum(t.adjoint(t.forward(v)) for t in terms)
    for _ in range(steps):
        x = x + K.conjugate_gradient(both, right + rho * sum(t.adjoint(a - b) for t, a, b in zip(terms, z, w, strict=True)) - both(x), inner)
        for i, t in enumerate(terms):
            g = t.forward(x) + w[i]
            z[i] = t.prox(g, 1 / rho)
            w[i] = g - z[i]
    return x


def consensus(kspace: DataFrame, maps: Side, mask: Side, terms: Sequence[Term], rho: float = 0.5, steps: int = 30, inner: int = 8, shape: Sequence[int] | None = None) -> DataFrame:
    """Images (y, x) of k-space (coil, y, x) under all terms at once."""
    return encoded(kspace, maps, mask, lambda y, m, p: split(normal_of(m, p), K.sense_adjoint(y, m, p), terms, rho, steps, inner), shape)


def subspace_consensus(kspace: DataFrame, shape: Sequence[int], maps: np.ndarray, mask: np.ndarray, basis: np.ndarray, terms: Sequence[Term], rho: float = 0.5, steps: int = 30, inner: int = 8) -> DataFrame:
    """Coefficient images (a, y, x) of frames (t, coil, y, x) under terms of these images, e.g. block low rank over a."""
    kernel = np.einsum("at,tyx,dt->adyx", np.conj(basis), np.abs(mask) ** 2, basis)

    def normal(x: np.ndarray) -> np.ndarray:
        mixed = np.einsum("adyx,bdcyx->bacyx", kernel, K.fft(x[:, :, None] * maps, (-2, -1), unitary=True))
        return (np.conj(maps) * K.fft(mixed, (-2, -1), inverse=True, unitary=True)).sum(2)

    return tile_map(kspace, shape, lambda y: split(normal, K.subspace_adjoint(y, maps, mask, basis), terms, rho, steps, inner))


def objective(normal: Map, right: np.ndarray, x: np.ndarray, terms: Sequence[Term]) -> np.ndarray:
    """1/2 |A x - y|^2 + penalties of every item, without the constant |y|^2 / 2."""
    fit = (np.conj(x) * (0.5 * normal(x) - right)).reshape(len(x), -1).sum(1).real
    return fit + sum(t.value(t.forward(x)) for t in terms)
