"""Batch reconstruction, denoising and fitting: every item is solved in its own tile, batches at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .transforms import tile_map, tile_values


#: Maps or a pattern for all items at once, or a table of tiles and the columns that join it.
Side = np.ndarray | tuple[DataFrame, Sequence[str]]


def encoded(kspace: DataFrame, maps: Side, mask: Side, solve: Callable, shape: Sequence[int] | None = None) -> DataFrame:
    """``solve(y, maps, mask)`` for every item, with the maps (coil, y, x) and the pattern (y, x) of its own.

    Tables of maps and patterns are joined on the columns that they have (a pattern per slice, per label or
    per study); arrays hold for all items.  Without ``shape`` every row's own one counts.
    """
    df, inputs, shapes, fixed = kspace, [("re", "im")], [shape], {}
    sides = {"maps": (maps, shape), "mask": (mask, tuple(shape[-2:]) if shape else (lambda own: own[-2:]))}
    for name, (side, size) in sides.items():
        if isinstance(side, np.ndarray):
            fixed[name] = side
            continue
        table, keys = side
        df = df.join(table.select(*keys, F.col("re").alias(f"{name}_re"), F.col("im").alias(f"{name}_im")), list(keys))
        inputs.append((f"{name}_re", f"{name}_im"))
        shapes.append(size)
    joined = [n for n in sides if n not in fixed]

    def run(y: np.ndarray, *more: np.ndarray) -> np.ndarray:
        own = fixed | dict(zip(joined, more, strict=True))
        pattern = own["mask"] if own["mask"].ndim == 2 else own["mask"][:, None]
        return solve(y, own["maps"], pattern)

    return tile_map(df, shape, run, inputs, shapes)


def normal_of(maps: np.ndarray, mask: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: K.sense_adjoint(K.sense_forward(x, maps, mask), maps, mask)


def sense_forward(images: DataFrame, maps: Side, mask: Side, shape: Sequence[int] | None = None) -> DataFrame:
    """Images that are stored as (1, y, x) to k-space (coil, y, x); the maps of a table must then have their shape given."""
    return encoded(images, maps, mask, lambda x, m, p: K.sense_forward(x[:, 0], m, p), shape)


def sense_adjoint(kspace: DataFrame, maps: Side, mask: Side, shape: Sequence[int] | None = None) -> DataFrame:
    return encoded(kspace, maps, mask, K.sense_adjoint, shape)


def cg_sense(kspace: DataFrame, maps: Side, mask: Side, steps: int = 30, lam: float = 0.0, smooth: float = 0.0, shape: Sequence[int] | None = None) -> DataFrame:
    """(A^H A + lam + smooth G^H G) x = A^H y, G being circular differences; converged items stop."""

    def solve(y: np.ndarray, m: np.ndarray, p: np.ndarray) -> np.ndarray:
        a = normal_of(m, p)
        full = (lambda x: a(x) + smooth * K.grad_adjoint(K.grad(x))) if smooth else a
        return K.conjugate_gradient(full, K.sense_adjoint(y, m, p), steps, lam)

    return encoded(kspace, maps, mask, solve, shape)


def pics(kspace: DataFrame, maps: Side, mask: Side, lam: float, steps: int = 30, prox: Callable | None = None, accelerate: bool = True, wavelet: str | None = None, eigen_step: bool = False, shape: Sequence[int] | None = None) -> DataFrame:
    """Proximal-gradient reconstruction with an l1 term of the image or of its wavelet coefficients, or a given prox, e.g. a denoiser.

    ``eigen_step`` divides the step by the largest eigenvalue of A^H A, found for every item.
    """

    def solve(y: np.ndarray, m: np.ndarray, p: np.ndarray) -> np.ndarray:
        shrink = prox or (lambda x, rate: K.soft(x, lam * rate) if wavelet is None else K.wavelet_soft(x, lam * (rate[..., 0] if isinstance(rate, np.ndarray) else rate), wavelet))
        rate: float | np.ndarray = 0.95
        if eigen_step:
            rate = 0.95 / np.maximum(K.largest_eigenvalue(normal_of(m, p), K.sense_adjoint(y, m, p)), 1e-12)[:, None, None]
        return K.fista(lambda x: K.sense_forward(x, m, p), lambda r: K.sense_adjoint(r, m, p), y, shrink, steps, rate, accelerate)

    return encoded(kspace, maps, mask, solve, shape)


def admm_tv(kspace: DataFrame, maps: Side, mask: Side, lam: float, rho: float = 0.5, steps: int = 20, shape: Sequence[int] | None = None) -> DataFrame:
    """Total variation by ADMM with conjugate-gradient inner solves."""

    def solve(y: np.ndarray, m: np.ndarray, p: np.ndarray) -> np.ndarray:
        b, a = K.sense_adjoint(y, m, p), normal_of(m, p)
        normal = lambda x: a(x) + rho * K.grad_adjoint(K.grad(x))
        z = np.zeros((len(b), 2, *b.shape[1:]), complex)
        w, x = np.zeros_like(z), b
        for _ in range(steps):
            x = K.conjugate_gradient(normal, b + rho * K.grad_adjoint(z - w), 8)
            g = K.grad(x) + w
            z = K.soft(g, lam / rho)
            w = g - z
        return x

    return encoded(kspace, maps, mask, solve, shape)


def primal_dual(kspace: DataFrame, maps: Side, mask: Side, lam: float, fourier: float = 0.0, steps: int = 60, shape: Sequence[int] | None = None) -> DataFrame:
    """Primal-dual steps for total variation plus, with ``fourier``, an l1 term of the image's spectrum."""

    def solve(y: np.ndarray, m: np.ndarray, p: np.ndarray) -> np.ndarray:
        b, a = K.sense_adjoint(y, m, p), normal_of(m, p)
        x, dual, spectrum = b.copy(), np.zeros((len(b), 2, *b.shape[1:]), complex), np.zeros_like(b)
        tau, sigma = 0.3, 0.2  # tau (1 / 2 + 9 sigma) < 1: the largest eigenvalues are 1 of A^H A, 8 of G^H G, 1 of F^H F
        clip = lambda v, top: v / np.maximum(1, np.abs(v) / max(top, 1e-300))
        for _ in range(steps):
            new = x - tau * (a(x) - b + K.grad_adjoint(dual) + K.fft(spectrum, (1, 2), inverse=True, unitary=True))
            dual = clip(dual + sigma * K.grad(2 * new - x), lam)
            spectrum = clip(spectrum + sigma * K.fft(2 * new - x, (1, 2), unitary=True), fourier)
            x = new
        return x

    return encoded(kspace, maps, mask, solve, shape)


def pocsense(kspace: DataFrame, maps: Side, mask: Side, sweeps: int = 50, lam: float = 0.0, wavelet: str | None = None, robust: float = 0.0, shape: Sequence[int] | None = None) -> DataFrame:
    """Sweeps of data consistency, projection on the coil model, and an optional threshold; gives k-space.

    ``robust`` keeps only what of the data's residual is beyond it, so that noise is not forced on the image.
    """

    def solve(y: np.ndarray, m: np.ndarray, p: np.ndarray) -> np.ndarray:
        k, one = y.copy(), np.ones_like(p)
        for _ in range(sweeps):
            x = K.sense_adjoint(k, m, one)
            x = (K.wavelet_soft(x, lam, wavelet) if wavelet else K.soft(x, lam)) if lam else x
            k = K.sense_forward(x, m, one)
            k = k + p * (K.soft(y - k, robust) if robust else y - k)
        return k

    return encoded(kspace, maps, mask, solve, shape)


def nlinv(kspace: DataFrame, mask: Side, steps: int = 6, a: float = 220.0, b: float = 32.0, coils: bool = False, shape: Sequence[int] | None = None) -> DataFrame:
    """Joint image and coils by a regularised Gauss-Newton method; the coil weight is (1 + a |k|^2)^(-b / 2).

    Gives the image times the root of sums of squares of the coils, or with ``coils`` a tile of
    1 + coils planes: that image, then the coils over that root.
    """
    f = lambda x: K.fft(x, (-2, -1), unitary=True)
    fh = lambda x: K.fft(x, (-2, -1), inverse=True, unitary=True)

    def solve(y: np.ndarray, _: np.ndarray, p: np.ndarray) -> np.ndarray:
        ny, nx = y.shape[2:]
        ky, kx = np.mgrid[-(ny // 2) : ny - ny // 2, -(nx // 2) : nx - nx // 2]
        weight = (1 + a * ((ky / ny) ** 2 + (kx / nx) ** 2)) ** (-b / 2)
        norm = np.sqrt((np.abs(y) ** 2).sum((1, 2, 3), keepdims=True))
        y = p * y * 100 / np.maximum(norm, 1e-300)
        z = np.zeros((len(y), y.shape[1] + 1, ny, nx), complex)
        z[:, 0] = 1
        start, alpha = z.copy(), 1.0
        for _ in range(steps):
            m, c = z[:, 0], fh(weight * z[:, 1:])
            fwd = lambda d, m=m, c=c: p * f(d[:, :1] * c + m[:, None] * fh(weight * d[:, 1:]))
            adj = lambda r, m=m, c=c: np.concatenate([(np.conj(c) * fh(p * r)).sum(1, keepdims=True), weight * f(np.conj(m)[:, None] * fh(p * r))], 1)
            res = y - p * f(m[:, None] * c)
            z = z + K.conjugate_gradient(lambda d: adj(fwd(d)), adj(res) + alpha * (start - z), 12, alpha)  # noqa: B023
            alpha /= 2
        c = fh(weight * z[:, 1:])
        root = np.sqrt((np.abs(c) ** 2).sum(1))
        image = z[:, 0] * root * norm[:, 0] / 100
        return np.concatenate((image[:, None], c / np.maximum(root, 1e-300)[:, None]), 1) if coils else image

    return encoded(kspace, np.zeros(0), mask, solve, shape)


def subspace_adjoint(kspace: DataFrame, shape: Sequence[int], maps: np.ndarray, mask: np.ndarray, basis: np.ndarray) -> DataFrame:
    """Coefficient images (a, y, x) from frames of k-space (t, coil, y, x)."""
    return tile_map(kspace, shape, lambda y: K.subspace_adjoint(y, maps, mask, basis))


def subspace_cg(kspace: DataFrame, shape: Sequence[int], maps: np.ndarray, mask: np.ndarray, basis: np.ndarray, steps: int = 30, lam: float = 0.0) -> DataFrame:
    """Least squares coefficients; the normal operator mixes frames once, by sum_t |pattern|^2 conj(basis) basis."""
    kernel = np.einsum("at,tyx,dt->adyx", np.conj(basis), np.abs(mask) ** 2, basis)

    def normal(x: np.ndarray) -> np.ndarray:
        spectra = K.fft(x[:, :, None] * maps, (-2, -1), unitary=True)
        mixed = np.einsum("adyx,bdcyx->bacyx", kernel, spectra)
        return (np.conj(maps) * K.fft(mixed, (-2, -1), inverse=True, unitary=True)).sum(2)

    return tile_map(kspace, shape, lambda y: K.conjugate_gradient(normal, K.subspace_adjoint(y, maps, mask, basis), steps, lam))


def nufft_sense(images: DataFrame, shape: Sequence[int], maps: np.ndarray, trajectory: np.ndarray, weights: np.ndarray | None = None) -> DataFrame:
    """W NUFFT S: images (y, x) to samples (coil, sample)."""
    return tile_map(images, shape, lambda x: np.stack([K.nufft(x * m, trajectory, weights) for m in maps], 1))


def nufft_sense_adjoint(samples: DataFrame, maps: np.ndarray, trajectory: np.ndarray, weights: np.ndarray | None = None) -> DataFrame:
    return tile_map(samples, (len(maps), len(trajectory)), lambda y: sum(np.conj(m) * K.nufft_adjoint(y[:, i], trajectory, m.shape, weights) for i, m in enumerate(maps)))


def field_corrected(tiles: DataFrame, shape: Sequence[int] | None, before: Sequence[np.ndarray], after: Sequence[np.ndarray], adjoint: bool = False) -> DataFrame:
    """Sum over segments of diag(after) E diag(before), E the unitary transform over the last two axes (so of every coil); or its adjoint."""
    e = lambda x, inverse: K.fft(x, (-2, -1), inverse=inverse, unitary=True)
    if adjoint:
        return tile_map(tiles, shape, lambda y: sum(np.conj(c) * e(np.conj(b) * y, True) for c, b in zip(before, after, strict=True)))
    return tile_map(tiles, shape, lambda x: sum(b * e(c * x, False) for c, b in zip(before, after, strict=True)))


def locally_low_rank(tiles: DataFrame, key: str, frame: str, shape: tuple[int, int], block: int, lam: float) -> DataFrame:
    """Soft-threshold the singular values of every block x block patch over the frames of a key (grid unshifted).

    Blocks at the far edges are smaller where the size is no multiple of the block.
    """
    ny, nx = shape

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(frame)
        x = (np.stack(pdf["re"]) + 1j * np.stack(pdf["im"])).reshape(1, -1, ny, nx)
        y = K.unblocked(K.soft_singular(K.blocks(x, block)[0], lam)[None], block, shape)[0].reshape(len(pdf), -1)
        return pdf.assign(re=list(y.real), im=list(y.imag))

    cols = f"{key} long, {frame} int, re array<double>, im array<double>"
    return tiles.select(F.col(key).cast("long").alias(key), F.col(frame).cast("int").alias(frame), "re", "im").groupBy(key).applyInPandas(run, cols)


def log_linear(df: DataFrame, key: str, te: str) -> DataFrame:
    """Mono-exponential decay from a straight line through the logarithms: m0 and t2 of every key."""
    y = F.log(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2))
    s = df.where((F.col("re") != 0) | (F.col("im") != 0)).groupBy(key).agg(F.regr_slope(y, F.col(te)).alias("s"), F.regr_intercept(y, F.col(te)).alias("b"))
    return s.where("s <> 0").select(key, F.exp("b").alias("m0"), (-1 / F.col("s")).alias("t2"))


def fit_voxels(series: DataFrame, key: str, times: Sequence[float], model: Callable[..., np.ndarray] = K.fit_decay, start: tuple[float, float] | None = (1.0, 100.0), names: Sequence[str] = ("m0", "t2")) -> DataFrame:
    """Gauss-Newton over batches of voxels; series has (key, e, re) with e in the order of ``times``.

    Without ``start`` a straight line through the logarithms gives it; all-zero voxels start at (1, 100).
    """
    g = series.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("e", "re"))).alias("v"))
    flat = g.select(key, F.transform("v", lambda v: v["re"]).alias("re"), F.transform("v", lambda v: v["re"] * 0).alias("im"))
    t = np.array(times, float)

    def run(x: np.ndarray) -> np.ndarray:
        y = x.real
        first = np.repeat([start or (1.0, 100.0)], len(y), 0)
        first[:, 0] = np.where(np.abs(y).sum(1) > 0, np.abs(y).max(1), first[:, 0])
        if start is None:
            v = np.log(np.maximum(np.abs(y), 1e-300))
            c = t - t.mean()
            slope = np.minimum((v * c).sum(1) / (c * c).sum(), -1e-6)
            ok = np.abs(y).min(1) > 0
            first = np.where(ok[:, None], np.stack([np.exp(np.minimum(v.mean(1) - slope * t.mean(), 300)), -1 / slope], 1), first)
        return model(t, y, first)

    return tile_values(flat, (len(t),), run, names)


def look_locker(mss: Column, m0: Column, r1star: Column, threshold: float, delay: float = 0.0) -> Column:
    """T1 = M0 / (Mss R1*) + 2 delay (the delay term is ours); zero below the threshold."""
    return F.when((m0 < threshold) | (mss * r1star == 0), 0.0).otherwise(m0 / (mss * r1star) + 2 * delay)


def dot_test(tiles: DataFrame, shape: Sequence[int], forward: Callable, adjoint: Callable) -> DataFrame:
    """|<A x, y> - <x, A^H y>| of every tile, y being the conjugate of A x times i: zero for an adjoint pair."""

    def run(x: np.ndarray) -> np.ndarray:
        ax = forward(x)
        y = 1j * np.conj(ax) + 1
        left = (np.conj(ax) * y).reshape(len(x), -1).sum(1)
        right = (np.conj(x) * adjoint(y)).reshape(len(x), -1).sum(1)
        return np.abs(left - right)[:, None]

    return tile_values(tiles, shape, run, ["gap"])


class Registry:
    """Named user operators on tiles: forward, adjoint and, for models, a derivative."""

    def __init__(self) -> None:
        self._known: dict[str, dict[str, Callable]] = {}

    def add(self, name: str, **functions: Callable) -> None:
        if "forward" not in functions:
            raise ValueError("an operator needs a forward function")
        self._known[name] = functions

    def apply(self, name: str, tiles: DataFrame, shape: Sequence[int], kind: str = "forward") -> DataFrame:
        return tile_map(tiles, shape, self._known[name][kind])


def gauss_newton(model: Callable, jacobian: Callable, steps: int = 10) -> Callable:
    """A fitter for ``fit_voxels`` from a user's model(t, p) and jacobian(t, p), solved for all voxels at once."""

    def fit(t: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
        p = start.astype(float).copy()
        for _ in range(steps):
            j = jacobian(t, p)
            a = np.einsum("btp,btq->bpq", j, j) + 1e-9 * np.eye(j.shape[2])
            p = p + np.linalg.solve(a, np.einsum("btp,bt->bp", j, y - model(t, p))[..., None])[..., 0]
        return p

    return fit


def iterate(frames: Iterator[np.ndarray], damp: float, solve: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[np.ndarray]:
    """Each frame solved with damp times its predecessor as the prior."""
    last = None
    for y in frames:
        last = solve(y, np.zeros_like(y) if last is None else damp * last)
        yield last
