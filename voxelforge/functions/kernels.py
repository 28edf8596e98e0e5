"""NumPy helpers on stacks of tiles (first axis: the tiles of a batch)."""

from __future__ import annotations

import numpy as np


def fft(x: np.ndarray, axes: tuple[int, ...], inverse: bool = False, unitary: bool = False, centred: bool = True) -> np.ndarray:
    """Unnormalised unless unitary, the inverse too; centred at n // 2."""
    if centred:
        x = np.fft.ifftshift(x, axes)
    n = float(np.prod([x.shape[a] for a in axes]))
    y = np.fft.ifftn(x, axes=axes) * n if inverse else np.fft.fftn(x, axes=axes)
    if unitary:
        y = y / np.sqrt(n)
    return np.fft.fftshift(y, axes) if centred else y


def _phases(k: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """exp(-2 pi i k (m - n // 2) / n) along y and x."""
    ny, nx = shape
    return np.exp(-2j * np.pi * np.outer(k[:, 0], np.arange(ny) - ny // 2) / ny), np.exp(-2j * np.pi * np.outer(k[:, 1], np.arange(nx) - nx // 2) / nx)


class Gridding:
    """Kaiser-Bessel interpolation between a trajectory and a grid of twice the size, for images too large for explicit sums."""

    WIDTH, BETA = 6, 13.8

    def __init__(self, k: np.ndarray, shape: tuple[int, int]):
        self.shape, self.wide = shape, tuple(2 * n for n in shape)
        at, weight, self.roll_off = [], [], []
        for axis in (0, 1):
            n, grid = shape[axis], self.wide[axis]
            place = 2 * k[:, axis] + grid // 2
            first = np.ceil(place - self.WIDTH / 2).astype(int)
            near = first[:, None] + np.arange(self.WIDTH)
            at.append(near % grid)
            weight.append(self._kernel(near - place[:, None]))
            fine = np.linspace(-self.WIDTH / 2, self.WIDTH / 2, 4001)
            step = fine[1] - fine[0]
            m = np.arange(n) - n // 2
            self.roll_off.append((self._kernel(fine) * np.cos(2 * np.pi * np.outer(m, fine) / grid)).sum(1) * step)
        self.at = (at[0][:, :, None] * self.wide[1] + at[1][:, None, :]).reshape(len(k), -1)
        self.weight = (weight[0][:, :, None] * weight[1][:, None, :]).reshape(len(k), -1)
        self.scale = 1 / np.outer(*self.roll_off)

    def _kernel(self, d: np.ndarray) -> np.ndarray:
        t = 1 - (2 * d / self.WIDTH) ** 2
        return np.where(t >= 0, np.i0(self.BETA * np.sqrt(np.maximum(t, 0))), 0) / np.i0(self.BETA)

    def _box(self) -> tuple:
        return (..., *(slice(g // 2 - n // 2, g // 2 - n // 2 + n) for n, g in zip(self.shape, self.wide, strict=True)))

    def forward(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), *self.wide), complex)
        wide[self._box()] = x * self.scale
        g = fft(wide, (1, 2)).reshape(len(x), -1)
        return (g[:, self.at] * self.weight).sum(2) / np.sqrt(np.prod(self.shape))

    def adjoint(self, y: np.ndarray) -> np.ndarray:
        g = np.zeros((len(y), int(np.prod(self.wide))), complex)
        for i, v in enumerate(y):  # a tile at a time: the samples of all grid cells add up
            spread = (v[:, None] * self.weight).ravel()
            g[i] = np.bincount(self.at.ravel(), spread.real, g.shape[1]) + 1j * np.bincount(self.at.ravel(), spread.imag, g.shape[1])
        im = fft(g.reshape(len(y), *self.wide), (1, 2), inverse=True)
        return im[self._box()] * self.scale / np.sqrt(np.prod(self.shape))


#: Voxels from which the transform goes over a grid instead of explicit sums.
GRID_FROM = 4096


def nufft(x: np.ndarray, k: np.ndarray, weights: np.ndarray | None = None, gridded: bool | None = None) -> np.ndarray:
    """y_j = w_j N^-1/2 sum_m x_m exp(-2 pi i k_j m / n); x (batch, ny, nx), k (samples, 2) as (ky, kx)."""
    w = 1.0 if weights is None else weights
    if x[0].size >= GRID_FROM if gridded is None else gridded:
        return w * Gridding(k, x.shape[1:]).forward(x)
    ey, ex = _phases(k, x.shape[1:])
    return w * np.einsum("sy,byx,sx->bs", ey, x, ex, optimize=True) / np.sqrt(x[0].size)


def nufft_adjoint(y: np.ndarray, k: np.ndarray, shape: tuple[int, int], weights: np.ndarray | None = None, gridded: bool | None = None) -> np.ndarray:
    y = y if weights is None else y * np.conj(weights)
    if shape[0] * shape[1] >= GRID_FROM if gridded is None else gridded:
        return Gridding(k, tuple(shape)).adjoint(y)
    ey, ex = _phases(k, shape)
    return np.einsum("sy,bs,sx->byx", ey.conj(), y, ex.conj(), optimize=True) / np.sqrt(shape[0] * shape[1])


def psf(weights: np.ndarray, k: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """h(m) = 1/N sum_j w_j exp(2 pi i k_j m / n) on the doubled grid, for the weights (batch, samples) of one trajectory."""
    ny, nx = shape
    ey = np.exp(2j * np.pi * np.outer(k[:, 0], np.arange(2 * ny) - ny) / ny)
    ex = np.exp(2j * np.pi * np.outer(k[:, 1], np.arange(2 * nx) - nx) / nx)
    return np.einsum("sy,bs,sx->byx", ey, weights, ex, optimize=True) / (nx * ny)


#: Analysis low-pass filters of the orthogonal wavelets haar and dau2.
LOW = {"haar": (0.7071067811865476, 0.7071067811865476), "dau2": (-0.12940952255092145, 0.22414386804185735, 0.836516303737469, 0.48296291314469025)}
#: Analysis and synthesis low-pass filters of the biorthogonal wavelet cdf44.
CDF44 = (
    (0.0, 0.03782845550726404, -0.023849465019556843, -0.11062440441843718, 0.37740285561283066, 0.8526986790088938, 0.37740285561283066, -0.11062440441843718, -0.023849465019556843, 0.03782845550726404),
    (0.0, -0.06453888262869706, -0.04068941760916406, 0.41809227322161724, 0.7884856164055829, 0.41809227322161724, -0.04068941760916406, -0.06453888262869706, 0.0, 0.0),
)
#: Lifting steps and the scale of cdf97.
LIFT, SCALE = (-1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971), 1.149604398860241
#: Coarsest scale of a wavelet transform.
COARSEST = 16


def filters(name: str) -> tuple[np.ndarray, ...]:
    """Analysis low and high, synthesis low and high."""
    if name == "cdf44":
        low, back = (np.array(f) for f in CDF44)
        sign = np.where(np.arange(len(low)) % 2 == 0, -1.0, 1.0)
        return low, sign * back, back, -sign * low
    low = np.array(LOW[name])
    high = low[::-1] * np.where(np.arange(len(low)) % 2 == 0, -1.0, 1.0)
    return low, high, low[::-1], high[::-1]


def dwt1(x: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """One level along the last axis with symmetric extension: floor((n + taps - 1) / 2) values a band."""
    low, high, *_ = filters(name)
    taps, n = len(low), x.shape[-1]
    ext = np.concatenate((x[..., : taps - 1][..., ::-1], x, x[..., n - taps + 1 :][..., ::-1]), -1)
    size = (n + taps - 1) // 2
    at = np.arange(size) * 2 + 1
    pick = np.stack([ext[..., at + j] for j in range(taps)], -1)
    return pick @ low[::-1], pick @ high[::-1]


def idwt1(a: np.ndarray, d: np.ndarray, n: int, name: str) -> np.ndarray:
    """Synthesis: upsample, filter, keep the n values in the middle."""
    *_, low, high = filters(name)
    taps, size = len(low), a.shape[-1]
    out = np.zeros((*a.shape[:-1], 2 * size + taps - 2), np.result_type(a, float))
    for j in range(taps):
        out[..., j : j + 2 * size : 2] += a * low[j] + d * high[j]
    return out[..., taps - 2 : taps - 2 + n]


def _levels(sizes: tuple[int, ...], taps: int) -> list[tuple[tuple[int, ...], list[bool], tuple[int, ...]]]:
    """(sizes, axes that are halved, sizes of a band) of every level; an axis goes on while its band has COARSEST values."""
    if min(sizes) < COARSEST:
        raise ValueError(f"every transformed axis needs {COARSEST} values")
    out, active = [], [True] * len(sizes)
    while any(active):
        band = tuple((n + taps - 1) // 2 if a else n for n, a in zip(sizes, active, strict=True))
        out.append((sizes, active, band))
        active = [a and n >= COARSEST for n, a in zip(band, active, strict=True)]
        sizes = band
    return out


def fwt(x: np.ndarray, axes: tuple[int, ...] = (-1,), name: str = "dau2") -> np.ndarray:
    """Coefficients of all transformed axes, coarse first, in one last axis; cdf97 keeps the shape."""
    if name == "cdf97":
        return _cdf97(x, axes)
    k = len(axes)
    low = np.moveaxis(x, axes, range(-k, 0))
    lead, parts = low.shape[:-k], []
    for _, active, band in _levels(low.shape[-k:], len(filters(name)[0])):
        bands = [low]
        for i in np.flatnonzero(active).tolist():
            bands = [np.moveaxis(h, -1, i - k) for b in bands for h in dwt1(np.moveaxis(b, i - k, -1), name)]
        low = bands[0]
        parts.insert(0, np.concatenate([b.reshape(*lead, -1) for b in bands[1:]], -1))
        assert low.shape[-k:] == band
    return np.concatenate([low.reshape(*lead, -1), *parts], -1)


def iwt(c: np.ndarray, sizes: tuple[int, ...], axes: tuple[int, ...] = (-1,), name: str = "dau2") -> np.ndarray:
    """The samples, of ``sizes`` along ``axes``, whose coefficients are ``c``."""
    if name == "cdf97":
        return _cdf97(c, axes, inverse=True)
    k, lead = len(axes), c.shape[:-1]
    levels = _levels(tuple(sizes), len(filters(name)[0]))
    at = int(np.prod(levels[-1][2]))
    low = c[..., :at].reshape(*lead, *levels[-1][2])
    for whole, active, band in reversed(levels):
        moved, n = np.flatnonzero(active).tolist(), int(np.prod(band))
        bands = [low]
        for _ in range(2 ** len(moved) - 1):
            bands.append(c[..., at : at + n].reshape(*lead, *band))
            at += n
        for i in reversed(moved):
            bands = [np.moveaxis(idwt1(np.moveaxis(a, i - k, -1), np.moveaxis(d, i - k, -1), whole[i], name), -1, i - k) for a, d in zip(bands[::2], bands[1::2], strict=True)]
        low = bands[0]
    return np.moveaxis(low, range(-k, 0), axes)


def _lift(x: np.ndarray, inverse: bool) -> np.ndarray:
    """One level of cdf97 along the last axis, in place: coarse half, then the negated detail; periodic if even, else mirrored."""
    n = x.shape[-1]
    half = n - n // 2
    s, d = (x[..., :half].copy(), x[..., half:].copy()) if inverse else (x[..., ::2].copy(), x[..., 1::2].copy())
    if n % 2:
        right = lambda v: v[..., 1:]
        pair = lambda v: np.concatenate((v[..., :1], v), -1) + np.concatenate((v, v[..., -1:]), -1)
    else:
        right = lambda v: np.roll(v, -1, -1)
        pair = lambda v: np.roll(v, 1, -1) + v
    left = lambda v: v[..., : d.shape[-1]]
    steps = list(enumerate(LIFT))
    if inverse:
        s, d = s / SCALE, -d * SCALE
    for i, f in reversed(steps) if inverse else steps:
        f = -f if inverse else f
        if i % 2 == 0:
            d = d + f * (left(s) + right(s))
        else:
            s = s + f * pair(d)
    if not inverse:
        return np.concatenate((s * SCALE, -d / SCALE), -1)
    out = np.empty_like(x)
    out[..., ::2], out[..., 1::2] = s, d
    return out


def _cdf97(x: np.ndarray, axes: tuple[int, ...], inverse: bool = False) -> np.ndarray:
    k = len(axes)
    out = np.moveaxis(x, axes, range(-k, 0)).copy()
    boxes = [out.shape[-k:]]
    if min(boxes[0]) < COARSEST:
        raise ValueError(f"every transformed axis needs {COARSEST} values")
    while min(boxes[-1]) > 2 * COARSEST:
        boxes.append(tuple(n - n // 2 for n in boxes[-1]))
    for box in reversed(boxes) if inverse else boxes:
        part = (..., *(slice(0, n) for n in box))
        for i in reversed(range(k)) if inverse else range(k):
            out[part] = np.moveaxis(_lift(np.moveaxis(out[part], i - k, -1), inverse), -1, i - k)
    return np.moveaxis(out, range(-k, 0), axes)


def wavelet_soft(x: np.ndarray, lam: float, name: str = "dau2") -> np.ndarray:
    """Soft threshold of the wavelet coefficients over all axes of every tile."""
    axes = tuple(range(1, x.ndim))
    return iwt(soft(fwt(x, axes, name), lam), x.shape[1:], axes, name)


def wavelet_top_k(x: np.ndarray, k: int, name: str = "dau2") -> np.ndarray:
    """The k largest wavelet coefficients of every tile; ties to the first."""
    axes = tuple(range(1, x.ndim))
    c = fwt(x, axes, name)
    flat = c.reshape(len(c), -1).copy()
    rank = np.argsort(np.argsort(-np.abs(flat), axis=1, kind="stable"), axis=1, kind="stable")
    flat[rank >= k] = 0
    return iwt(flat.reshape(c.shape), x.shape[1:], axes, name)


def ssim(x: np.ndarray, r: np.ndarray, width: int = 7) -> np.ndarray:
    """Mean over whole uniform windows, k1 = 0.01, k2 = 0.03, range 1, population statistics; images over max |r|."""
    top = np.maximum(np.abs(r).max((1, 2), keepdims=True), 1e-300)
    x, r = np.abs(x) / top, np.abs(r) / top

    def mean(a: np.ndarray) -> np.ndarray:
        c = np.pad(a.cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
        return (c[:, width:, width:] - c[:, :-width, width:] - c[:, width:, :-width] + c[:, :-width, :-width]) / width**2

    mx, mr = mean(x), mean(r)
    vx, vr, cov = mean(x * x) - mx * mx, mean(r * r) - mr * mr, mean(x * r) - mx * mr
    s = (2 * mx * mr + 1e-4) * (2 * cov + 9e-4) / ((mx * mx + mr * mr + 1e-4) * (vx + vr + 9e-4))
    return s.mean((1, 2))


def shift(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sub-voxel (dy, dx) that moves b onto a: slope of the cross spectrum's phase over the low quarter, weighted by its size."""
    cross = np.fft.fftshift(np.fft.fft2(a) * np.conj(np.fft.fft2(b)), (1, 2))
    low = [slice(n // 2 - max(1, n // 4), n // 2 + max(1, n // 4) + 1) for n in a.shape[1:]]
    cross, out = cross[:, low[0], low[1]], []
    for axis in (1, 2):
        last = cross.shape[axis] - 1
        step = np.take(cross, range(1, last + 1), axis) * np.conj(np.take(cross, range(last), axis))
        out.append(-np.angle(step.sum((1, 2))) * a.shape[axis] / (2 * np.pi))
    return np.stack(out, -1)


def soft_singular(m: np.ndarray, lam: float) -> np.ndarray:
    """Soft-threshold the singular values of stacked matrices."""
    u, s, v = np.linalg.svd(m, full_matrices=False)
    return (u * np.maximum(s - lam, 0)[..., None, :]) @ v


def blocks(x: np.ndarray, size: int) -> np.ndarray:
    """(item, a, y, x) as matrices (item, block, a, size^2); blocks at the far edges are filled with zeros."""
    b, a, ny, nx = x.shape
    x = np.pad(x, ((0, 0), (0, 0), (0, -ny % size), (0, -nx % size)))
    x = x.reshape(b, a, x.shape[2] // size, size, x.shape[3] // size, size)
    return x.transpose(0, 2, 4, 1, 3, 5).reshape(b, -1, a, size * size)


def unblocked(m: np.ndarray, size: int, shape: tuple[int, int]) -> np.ndarray:
    """Inverse of ``blocks`` for images of this shape."""
    ny, nx = (-(-n // size) for n in shape)
    x = m.reshape(len(m), ny, nx, m.shape[2], size, size).transpose(0, 3, 1, 4, 2, 5)
    return x.reshape(len(m), m.shape[2], ny * size, nx * size)[:, :, : shape[0], : shape[1]]


def sense_forward(x: np.ndarray, maps: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(batch, y, x) -> (batch, coil, y, x): coils, unitary transform, pattern."""
    return fft(x[:, None] * maps, (-2, -1), unitary=True) * mask


def sense_adjoint(y: np.ndarray, maps: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return (np.conj(maps) * fft(y * np.conj(mask), (-2, -1), inverse=True, unitary=True)).sum(1)


def subspace_forward(x: np.ndarray, maps: np.ndarray, mask: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """(batch, a, y, x) -> (batch, t, coil, y, x): coefficients to frames by basis (a, t), coils, transform, pattern (t, y, x)."""
    spectra = fft(x[:, :, None] * maps, (-2, -1), unitary=True)
    return np.einsum("at,bacyx->btcyx", basis, spectra) * mask[:, None]


def subspace_adjoint(y: np.ndarray, maps: np.ndarray, mask: np.ndarray, basis: np.ndarray) -> np.ndarray:
    spectra = np.einsum("at,btcyx->bacyx", np.conj(basis), y * np.conj(mask)[:, None])
    return (np.conj(maps) * fft(spectra, (-2, -1), inverse=True, unitary=True)).sum(2)


def conjugate_gradient(normal, b: np.ndarray, steps: int, lam: float = 0.0, tolerance: float = 1e-12) -> np.ndarray:
    """Solve (normal + lam) x = b for every tile of the batch; tiles below the relative residual stand still, and all end it."""
    dot = lambda u, v: (np.conj(u) * v).reshape(len(u), -1).sum(1).real
    wide = lambda s: s.reshape(-1, *([1] * (b.ndim - 1)))
    x, r = np.zeros_like(b), b.copy()
    p, rr = r.copy(), dot(r, r)
    enough = tolerance**2 * rr
    for _ in range(steps):
        live = rr > enough
        if not live.any():
            break
        q = normal(p) + lam * p
        a = np.where(live, rr / np.maximum(dot(p, q), 1e-300), 0)
        x, r = x + wide(a) * p, r - wide(a) * q
        new = dot(r, r)
        p, rr = np.where(wide(live), r + wide(new / np.maximum(rr, 1e-300)) * p, p), new
    return x


def largest_eigenvalue(normal, like: np.ndarray, steps: int = 30) -> np.ndarray:
    """Of every tile, by power iterations from a fixed start."""
    x = np.broadcast_to(np.cos(np.arange(like[0].size)).reshape(like.shape[1:]), like.shape).astype(complex)
    size = lambda v: np.sqrt((np.abs(v) ** 2).reshape(len(v), -1).sum(1))
    wide = lambda v: v.reshape(-1, *([1] * (like.ndim - 1)))
    top = np.zeros(len(like))
    for _ in range(steps):
        x = normal(x / np.maximum(wide(size(x)), 1e-300))
        top = size(x)
    return top


def fista(forward, adjoint, y: np.ndarray, prox, steps: int, rate: float | np.ndarray = 0.95, accelerate: bool = True) -> np.ndarray:
    """Proximal gradient steps, with momentum unless plain."""
    x = np.zeros_like(adjoint(y))
    z, t = x, 1.0
    for _ in range(steps):
        new = prox(z - rate * adjoint(forward(z) - y), rate)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2 if accelerate else 1.0
        z = new + ((t - 1) / t2 if accelerate else 0.0) * (new - x)
        x, t = new, t2
    return x


def soft(x: np.ndarray, lam: float) -> np.ndarray:
    m = np.abs(x)
    return x * np.maximum(1 - lam / np.maximum(m, 1e-300), 0)


def grad(x: np.ndarray) -> np.ndarray:
    return np.stack([np.roll(x, -1, 1) - x, np.roll(x, -1, 2) - x], 1)


def grad_adjoint(g: np.ndarray) -> np.ndarray:
    return np.roll(g[:, 0], 1, 1) - g[:, 0] + np.roll(g[:, 1], 1, 2) - g[:, 1]


def _laplace(shape: tuple[int, int]) -> np.ndarray:
    f = [2 - 2 * np.cos(2 * np.pi * np.arange(n) / n) for n in shape]
    return f[0][:, None] + f[1][None, :]


def rof(x: np.ndarray, lam: float, steps: int = 50, rho: float = 0.1) -> np.ndarray:
    """min |u - x|^2 / 2 + lam TV(u), isotropic and periodic, by ADMM; the quadratic step is exact in Fourier."""
    z = np.zeros((len(x), 2, *x.shape[1:]), x.dtype)
    w, den = np.zeros_like(z), 1 + rho * _laplace(x.shape[1:])
    u = x
    for _ in range(steps):
        u = np.fft.ifft2(np.fft.fft2(x + rho * grad_adjoint(z - w)) / den)
        g = grad(u) + w
        m = np.sqrt((np.abs(g) ** 2).sum(1, keepdims=True))
        z = g * np.maximum(1 - (lam / rho) / np.maximum(m, 1e-300), 0)
        w = g - z
    return u


def tgv(x: np.ndarray, lam: float, ratio: float = 3**0.5, steps: int = 200) -> np.ndarray:
    """Second-order total generalised variation by primal-dual steps: lam |grad u - v| + ratio lam |sym grad v|.

    The weights (1, sqrt 3) are the documented ones; the minimum is the same whatever solver finds it.
    """
    u, v = x.copy(), np.zeros((len(x), 2, *x.shape[1:]), x.dtype)
    ub, vb = u, v
    p, q = np.zeros_like(v), np.zeros((len(x), 3, *x.shape[1:]), x.dtype)
    tau = sigma = 1 / np.sqrt(12.0)

    def sym(v: np.ndarray) -> np.ndarray:
        a, b = grad(v[:, 0]), grad(v[:, 1])
        return np.stack([a[:, 0], b[:, 1], (a[:, 1] + b[:, 0]) / 2], 1)

    def sym_adjoint(q: np.ndarray) -> np.ndarray:
        return np.stack([grad_adjoint(np.stack([q[:, 0], q[:, 2]], 1)), grad_adjoint(np.stack([q[:, 2], q[:, 1]], 1))], 1)

    for _ in range(steps):
        p = p + sigma * (grad(ub) - vb)
        p = p / np.maximum(1, np.sqrt((np.abs(p) ** 2).sum(1, keepdims=True)) / lam)
        q = q + sigma * sym(vb)
        q = q / np.maximum(1, np.sqrt((np.abs(q[:, :2]) ** 2).sum(1, keepdims=True) + 2 * np.abs(q[:, 2:]) ** 2) / (ratio * lam))
        un = (u - tau * grad_adjoint(p) + tau * x) / (1 + tau)
        vn = v + tau * (p - sym_adjoint(q))
        ub, vb, u, v = 2 * un - u, 2 * vn - v, un, vn
    return u


def nlmeans(x: np.ndarray, patch: int = 5, distance: int = 2, h: float = 0.1, a: float = 1.0) -> np.ndarray:
    """Gaussian-weighted patch distances, reflected edges; distance 0 is the identity."""
    if patch % 2 == 0:
        raise ValueError("patch length must be odd")
    r, n = patch // 2, distance
    t = np.arange(-r, r + 1)
    g = np.exp(-(t[:, None] ** 2 + t[None, :] ** 2) / (2 * a * a))
    norm = np.sqrt((g * g).sum())
    wide = np.pad(x, ((0, 0), (r + n, r + n), (r + n, r + n)), mode="reflect") if r + n else x
    ny, nx = x.shape[1:]
    core = lambda dy, dx: wide[:, r + n + dy : r + n + dy + ny, r + n + dx : r + n + dx + nx]
    num, den = np.zeros_like(x), np.zeros(x.shape)
    for dy in range(-n, n + 1):
        for dx in range(-n, n + 1):
            d = sum(g[i + r, j + r] * np.abs(core(i, j) - core(dy + i, dx + j)) ** 2 for i in range(-r, r + 1) for j in range(-r, r + 1))
            w = np.exp(-d / (2 * h * h * norm))
            num, den = num + w * core(dy, dx), den + w
    return num / den


def homodyne(k: np.ndarray, fraction: float) -> np.ndarray:
    """Partial Fourier along y: ramp weights (0 to 2 over the symmetric centre) and a low-resolution phase."""
    ny = k.shape[1]
    have = int(round(fraction * ny))
    c = ny // 2
    half = max(1, have - c)
    i = np.arange(ny)
    w = np.where(i < c - half, 2.0, np.where(i >= c + half, 0.0, 1 - (i - c) / half))
    full = np.where(i < have, 1.0, 0.0)
    low = np.where(np.abs(i - c) < half, 1.0, 0.0)
    inv = lambda z: fft(z, (1, 2), inverse=True, unitary=True)
    ph = np.exp(-1j * np.angle(inv(k * low[:, None])))
    return (inv(k * (w * full)[:, None]) * ph).real


def fit_decay(t: np.ndarray, y: np.ndarray, start: np.ndarray, steps: int = 20, low: float = 1.0, high: float = 1000.0) -> np.ndarray:
    """Gauss-Newton for M0 exp(-t / T2), all voxels at once; all-zero voxels keep their start."""
    p = start.astype(float).copy()
    live = np.abs(y).sum(1) > 0
    for _ in range(steps):
        e = np.exp(-t[None] / p[:, 1:2])
        r = y - p[:, :1] * e
        j0, j1 = e, p[:, :1] * e * t[None] / p[:, 1:2] ** 2
        a, b, c = (j0 * j0).sum(1), (j0 * j1).sum(1), (j1 * j1).sum(1)
        g0, g1 = (j0 * r).sum(1), (j1 * r).sum(1)
        det = np.maximum(a * c - b * b, 1e-300)
        d = np.stack([(c * g0 - b * g1) / det, (a * g1 - b * g0) / det], 1)
        p = np.where(live[:, None], p + np.clip(d, -p * 0.9, p * 4 + 1), p)
        p[:, 1] = np.clip(p[:, 1], low, high)
    return p


def fit_recovery(t: np.ndarray, y: np.ndarray, start: np.ndarray, steps: int = 20, low: float = 10.0, high: float = 5000.0) -> np.ndarray:
    """Gauss-Newton for M0 (1 - 2 exp(-t / T1))."""
    p = start.astype(float).copy()
    live = np.abs(y).sum(1) > 0
    for _ in range(steps):
        e = np.exp(-t[None] / p[:, 1:2])
        j0, j1 = 1 - 2 * e, -2 * p[:, :1] * e * t[None] / p[:, 1:2] ** 2
        r = y - p[:, :1] * j0
        a, b, c = (j0 * j0).sum(1), (j0 * j1).sum(1), (j1 * j1).sum(1)
        g0, g1 = (j0 * r).sum(1), (j1 * r).sum(1)
        det = np.maximum(a * c - b * b, 1e-300)
        p = np.where(live[:, None], p + np.stack([(c * g0 - b * g1) / det, np.clip((a * g1 - b * g0) / det, -500, 500)], 1), p)
        p[:, 1] = np.clip(p[:, 1], low, high)
    return p


def dominant(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalue and its vector (first component's phase 0) of stacked Hermitian matrices."""
    w, v = np.linalg.eigh(c)
    v = v[..., -1]
    ph = v[..., :1] / np.maximum(np.abs(v[..., :1]), 1e-300)
    return w[..., -1], v * np.conj(ph)


def espirit(k: np.ndarray, kernel: int = 3, threshold: float = 0.02, crop: float = 0.8, calibration: int | None = None, sets: int = 1, soft_weight: bool = False) -> np.ndarray:
    """Sensitivities (set, coil, y, x) from one slice's k-space: calibration matrix of the centre, its signal space in the image, eigenvectors.

    Voxels whose eigenvalue, as a share of the largest, is below ``crop`` are zero, or with ``soft_weight``
    are weighted by a ramp that is one from ``crop`` on.
    """
    nc, ny, nx = k.shape
    cy, cx = (min(n, calibration or n) for n in (ny, nx))
    inner = k[:, ny // 2 - cy // 2 : ny // 2 - cy // 2 + cy, nx // 2 - cx // 2 : nx // 2 - cx // 2 + cx]
    blocks = np.lib.stride_tricks.sliding_window_view(inner, (kernel, kernel), (1, 2)).transpose(1, 2, 0, 3, 4).reshape(-1, nc * kernel * kernel)
    _, s, v = np.linalg.svd(blocks, full_matrices=False)
    v = v[s > threshold * s[0]].reshape(-1, nc, kernel, kernel)
    c = np.zeros((ny, nx, nc, nc), complex)
    for own in v:  # a kernel at a time keeps one image of every coil in memory
        wide = np.zeros((nc, ny, nx), complex)
        wide[:, ny // 2 - kernel // 2 : ny // 2 - kernel // 2 + kernel, nx // 2 - kernel // 2 : nx // 2 - kernel // 2 + kernel] = np.conj(own[:, ::-1, ::-1])
        im = fft(wide, (-2, -1), inverse=True) / kernel
        c += np.einsum("ayx,byx->yxab", np.conj(im), im)
    w, e = np.linalg.eigh(c)
    w, e = w[..., ::-1][..., :sets], e[..., ::-1][..., :sets]
    first = e[..., :1, :]
    e = e * np.conj(first / np.maximum(np.abs(first), 1e-300))
    share = w / max(w.max(), 1e-300)
    e = e * (np.clip(share / crop, 0, 1) if soft_weight else (share >= crop))[..., None, :]
    return e.transpose(3, 2, 0, 1)
