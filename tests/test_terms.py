"""Penalties of one and of several terms."""

import numpy as np
import pytest
from voxelforge.functions import kernels as K
from voxelforge.operators import recon as B
from voxelforge.operators import terms as T


def data(n=16, coils=3, items=3, seed=1):
    rng = np.random.default_rng(seed)
    maps = rng.normal(size=(coils, n, n)) + 1j * rng.normal(size=(coils, n, n))
    maps /= np.sqrt((np.abs(maps) ** 2).sum(0))
    x = np.kron(rng.normal(size=(items, 4, 4)), np.ones((n // 4, n // 4))) + 0j
    mask = ((np.arange(n)[:, None] % 2 == 0) | (np.abs(np.arange(n)[:, None] - n // 2) < 3)) * np.ones((n, n))
    return K.sense_forward(x, maps, mask) + 0.02 * rng.normal(size=(items, coils, n, n)), maps, mask, x


ONE = {"tv": T.total_variation(0.02), "laplace": T.laplace(0.01), "fourier": T.fourier(0.02), "wavelet": T.wavelet(0.02), "image": T.l1(0.02)}


@pytest.mark.parametrize("name", ["tv", "laplace", "fourier"])
def test_adjoint_pairs(name):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2, 6, 5)) + 1j * rng.normal(size=(2, 6, 5))
    t = ONE[name]
    y = t.forward(x) * 1j + rng.normal(size=t.forward(x).shape)
    np.testing.assert_allclose(np.vdot(t.forward(x), y), np.vdot(x, t.adjoint(y)))


@pytest.mark.parametrize("size", [2, 3, 8])
def test_blocks_and_their_singular_values(size):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2, 4, 7, 8)) + 1j * rng.normal(size=(2, 4, 7, 8))
    assert (K.unblocked(K.blocks(x, size), size, (7, 8)) == x).all()
    got, want = T.low_rank(0.7, size).prox(x, 2.0), np.empty_like(x)
    for a in range(0, 7, size):
        for b in range(0, 8, size):
            part = x[:, :, a : a + size, b : b + size]
            want[:, :, a : a + size, b : b + size] = [K.soft_singular(p.reshape(4, -1).T[None], 1.4)[0].T.reshape(p.shape) for p in part]
    np.testing.assert_allclose(got, want, atol=1e-10)


def test_two_terms_beat_every_single_one():
    y, maps, mask, _ = data()
    normal, right = B.normal_of(maps, mask), K.sense_adjoint(y, maps, mask)
    for pair in (("tv", "wavelet"), ("laplace", "fourier"), ("tv", "image")):
        both = [ONE[n] for n in pair]
        x = T.split(normal, right, both, 0.5, 150)
        for single in both:
            alone = T.split(normal, right, [single], 0.5, 150)
            assert (T.objective(normal, right, x, both) < T.objective(normal, right, alone, both)).all()
            assert (T.objective(normal, right, alone, [single]) <= T.objective(normal, right, x, [single]) + 1e-9).all()
        for _ in range(3):  # no neighbour is better
            near = x + 1e-3 * np.random.default_rng(4).normal(size=x.shape)
            assert (T.objective(normal, right, x, both) < T.objective(normal, right, near, both)).all()


def test_tables(spark):
    """One term is total variation; low rank over frames of a subspace recovers images that repeat."""
    y, maps, mask, x = data()
    rows = [(i, [3, 16, 16], v.real.ravel().tolist(), v.imag.ravel().tolist()) for i, v in enumerate(y)]
    k = spark.createDataFrame(rows, "item int, shape array<int>, re array<double>, im array<double>")
    image = lambda df: np.array([np.array(r["re"]) + 1j * np.array(r["im"]) for r in df.orderBy("item").collect()])
    one = image(T.consensus(k, maps, mask, [T.total_variation(0.02)], 0.5, 60, inner=20))
    other, tv = image(B.admm_tv(k, maps, mask, 0.02, 0.5, 60)), [T.total_variation(0.02)]
    np.testing.assert_allclose(one, other, atol=0.05)
    worth = lambda v: T.objective(B.normal_of(maps, mask), K.sense_adjoint(y, maps, mask), v.reshape(3, 16, 16), tv)
    assert (worth(one) <= worth(other) + 1e-9).all()
    least = image(T.consensus(k, maps, mask, [], steps=10))
    np.testing.assert_allclose(least, image(B.cg_sense(k, maps, mask, 80)), atol=1e-6)
    frames = np.stack([(x[0] * a + x[1] * b) for a, b in ((1, 0), (0.5, 0.5), (0, 1), (1, 1))])
    seen = np.stack([(np.arange(16)[:, None] % 2 == t % 2) * np.ones((16, 16)) for t in range(4)])
    basis = np.linalg.qr(np.random.default_rng(5).normal(size=(4, 4)))[0]
    s = np.stack([K.sense_forward(f[None], maps, m)[0] for f, m in zip(frames, seen, strict=True)])
    df = spark.createDataFrame([(0, s.real.ravel().tolist(), s.imag.ravel().tolist())], "item int, re array<double>, im array<double>")
    got = image(T.subspace_consensus(df, (4, 3, 16, 16), maps, seen, basis, [T.low_rank(1e-3, 16)], 0.1, 60)).reshape(4, 16, 16)
    assert np.abs(np.einsum("at,ayx->tyx", basis, got) - frames).max() < 0.02 * np.abs(frames).max()


def test_low_rank_acts_on_the_subspace_map(spark):
    """The penalty of the query takes a singular value of many blocks."""
    from conftest import DATA
    from voxelforge.jobs import queries as Q

    basis = Q._decay_basis(spark, f"{DATA}/sf0.001", 4)
    rows = Q._subspace_coefficients(spark, f"{DATA}/sf0.001", basis).collect()
    x = np.array([np.array(r["re"]) + 1j * np.array(r["im"]) for r in rows]).reshape(-1, 4, 4, 4)
    full = [i for i, r in enumerate(rows) if 0 <= r["slice"] < 12]  # slices without a missing part
    last = np.linalg.svd(K.blocks(x[full], 2), compute_uv=False)[..., -1]
    assert last.size == 48 and 0.25 < (last < 1e-5).mean() < 1
