"""NumPy helpers against their definitions, adjoint pairs and known truths."""

import numpy as np
import pytest
from voxelforge.functions import kernels as K
from voxelforge.operators import recon as B
from voxelforge.sources import cfl

RNG = np.random.default_rng(3)


def cplx(*shape):
    return RNG.standard_normal(shape) + 1j * RNG.standard_normal(shape)


@pytest.mark.parametrize("n", [8, 7])
def test_fft_is_the_centred_sum(n):
    x = cplx(1, n)
    i = np.arange(n) - n // 2
    assert np.allclose(K.fft(x, (1,))[0], np.exp(-2j * np.pi * np.outer(i, i) / n) @ x[0])
    assert np.allclose(K.fft(K.fft(x, (1,)), (1,), inverse=True), n * x)


def test_adjoint_pairs():
    maps, mask = birdcage(4, (8, 8)), (RNG.random((8, 8)) > 0.5).astype(float)
    x, y = cplx(2, 8, 8), cplx(2, 4, 8, 8)
    assert np.isclose(np.vdot(K.sense_forward(x, maps, mask), y), np.vdot(x, K.sense_adjoint(y, maps, mask)))
    k = RNG.uniform(-4, 4, (20, 2))
    s = cplx(2, 20)
    assert np.isclose(np.vdot(K.nufft(x, k), s), np.vdot(x, K.nufft_adjoint(s, k, (8, 8))))
    g = cplx(2, 2, 8, 8)
    assert np.isclose(np.vdot(K.grad(x), g), np.vdot(x, K.grad_adjoint(g)))


def birdcage(coils, shape):
    """Smooth unit-norm sensitivities, for simulated encodings."""
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    t = 2 * np.pi * np.arange(coils) / coils
    cy, cx = shape[0] / 2 + 0.7 * shape[0] * np.sin(t), shape[1] / 2 + 0.7 * shape[1] * np.cos(t)
    d = np.hypot(y - cy[:, None, None], x - cx[:, None, None])
    m = np.exp(-((d / max(shape)) ** 2)) * np.exp(1j * (t[:, None, None] + 0.1 * (x - y)))
    return m / np.sqrt((np.abs(m) ** 2).sum(0, keepdims=True))


@pytest.mark.parametrize("name", ["haar", "dau2", "cdf44", "cdf97"])
@pytest.mark.parametrize(("shape", "axes"), [((3, 16), (-1,)), ((3, 33), (-1,)), ((3, 64), (1,)), ((2, 27, 19), (-2, -1)), ((37, 2), (0,)), ((2, 21, 3, 16), (1, 3)), ((1, 70, 65), (1, 2))])
def test_wavelet_round_trip(name, shape, axes):
    x = cplx(*shape)
    c = K.fwt(x, axes, name)
    assert np.allclose(K.iwt(c, tuple(shape[a] for a in axes), axes, name), x)
    if name == "cdf97":
        assert c.shape == x.shape


def test_wavelet_conventions():
    x = RNG.standard_normal((4, 30))
    assert K.fwt(x, (1,), "dau2").shape[-1] == 9 + 9 + 16  # bands of 16, then of 9, as a band of 16 goes on
    taps = {name: len(K.filters(name)[0]) for name in ("haar", "dau2", "cdf44")}
    for name, n in taps.items():
        low, high = K.dwt1(x, name)
        assert low.shape[-1] == high.shape[-1] == (30 + n - 1) // 2
        flat, smooth = np.ones((1, 40)), K.dwt1(np.ones((1, 40)), name)
        assert np.allclose(smooth[0], np.sqrt(2)) and np.allclose(smooth[1], 0, atol=1e-9) and flat.shape == (1, 40)
    even = RNG.standard_normal((2, 32, 64))
    assert np.isclose((K.fwt(even, (1, 2), "haar") ** 2).sum(), (even**2).sum())  # orthogonal on even lengths
    one = K.fwt(np.ones((1, 32)), (1,), "cdf97")
    assert np.allclose(one[:, 16:], 0, atol=1e-9) and np.allclose(one[:, :16], np.sqrt(2) / np.sqrt(2) * one[0, 0])
    assert not np.allclose(K.fwt(x[:, :16], (1,), "cdf97")[:, :8], x[:, :16:2])
    with pytest.raises(ValueError):
        K.fwt(x[:, :15], (1,))
    kept = K.wavelet_top_k(RNG.standard_normal((2, 16, 16)), 5, "haar")
    assert (np.abs(K.fwt(kept, (1, 2), "haar")) > 1e-9).sum() == 10


def test_gridding_is_close_to_the_explicit_sum():
    for shape in ((32, 32), (31, 40)):
        k = RNG.uniform(-0.5, 0.5, (200, 2)) * shape
        x, y = cplx(2, *shape), cplx(2, 200)
        want = K.nufft(x, k, gridded=False)
        assert np.abs(K.nufft(x, k, gridded=True) - want).max() < 1e-3 * np.abs(want).max()
        back = K.nufft_adjoint(y, k, shape, gridded=True)
        want = K.nufft_adjoint(y, k, shape, gridded=False)
        assert np.abs(back - want).max() < 1e-3 * np.abs(want).max()
        assert np.isclose(np.vdot(K.nufft(x, k, gridded=True), y), np.vdot(x, back))
    w = RNG.random(200)
    assert np.allclose(K.nufft(x, k, w), w * K.nufft(x, k))


def test_subspace_pair_and_solution():
    maps, basis = birdcage(3, (8, 8)), np.linalg.qr(RNG.standard_normal((5, 2)))[0].T
    mask = (RNG.random((5, 8, 8)) > 0.4).astype(float)
    x, y = cplx(2, 2, 8, 8), cplx(2, 5, 3, 8, 8)
    assert np.isclose(np.vdot(K.subspace_forward(x, maps, mask, basis), y), np.vdot(x, K.subspace_adjoint(y, maps, mask, basis)))


def test_cg_sense_recovers_the_image():
    maps, mask = birdcage(4, (8, 8)), np.ones((8, 8))
    mask[1::4] = 0
    x = cplx(2, 8, 8)
    y = K.sense_forward(x, maps, mask)
    normal = lambda v: K.sense_adjoint(K.sense_forward(v, maps, mask), maps, mask)
    assert np.allclose(K.conjugate_gradient(normal, K.sense_adjoint(y, maps, mask), 200), x, atol=1e-3)


def test_fits_recover_known_truth():
    t = 12.5 * np.arange(1, 9)
    t2 = np.array([60.0, 110.0, 20.0])
    y = 5 * np.exp(-t / t2[:, None])
    p = K.fit_decay(t, np.vstack([y, np.zeros(8)]), np.array([[4.0, 70.0]] * 3 + [[1.0, 77.0]]))
    assert np.allclose(p[:3, 1], t2, rtol=1e-3) and p[3, 1] == 77.0
    ti = np.array([50.0, 200, 400, 800, 1500, 2500, 4000])
    q = K.fit_recovery(ti, 3 * (1 - 2 * np.exp(-ti / np.array([[800.0], [1400.0]]))), np.array([[3.0, 1000.0]] * 2))
    assert np.allclose(q[:, 1], [800, 1400], rtol=1e-3)


def test_denoisers():
    x = np.zeros((1, 16, 16))
    x[:, 4:12, 4:12] = 1
    noisy = x + 0.1 * RNG.standard_normal(x.shape)
    for y in (K.rof(noisy, 0.1).real, K.tgv(noisy, 0.1), K.nlmeans(noisy, 3, 3, 0.15)):
        assert np.abs(y - x).mean() < np.abs(noisy - x).mean()
    assert np.isclose(K.rof(noisy, 0.1).real.mean(), noisy.mean())
    assert np.allclose(K.nlmeans(noisy, 3, 0), noisy)
    with pytest.raises(ValueError):
        K.nlmeans(noisy, 4)


def test_metrics_and_maps():
    r = RNG.random((2, 16, 16))
    assert np.allclose(K.ssim(r, r), 1)
    y, x = np.mgrid[0:32, 0:32]
    blob = np.exp(-((y - 15) ** 2 + (x - 16) ** 2) / 20.0)[None]
    moved = np.roll(blob, (2, -3), (1, 2))
    assert np.allclose(K.shift(blob, moved)[0], [-2, 3], atol=0.05)
    maps = K.espirit(K.sense_forward(np.ones((1, 8, 8)), birdcage(4, (8, 8)), np.ones((8, 8)))[0])[0]
    norm = (np.abs(maps) ** 2).sum(0)
    assert np.all(np.isclose(norm, 1) | np.isclose(norm, 0))


def test_array_file_headers():
    assert cfl.parse_header("# Dimensions\n8 16 1 4 1 1\n") == [8, 16, 1, 4]
    assert cfl.parse_header(cfl.format_header([3])) == [3]
    assert cfl.parse_header(cfl.format_header([1, 1])) == [1]


def test_low_rank_threshold_keeps_large_singular_values():
    m = cplx(1, 6, 4)
    s = np.linalg.svd(K.soft_singular(m, 0.5)[0], compute_uv=False)
    assert np.allclose(s, np.maximum(np.linalg.svd(m[0], compute_uv=False) - 0.5, 0))
