"""Transforms of lines that exceed a tile, and solvers whose state is a table."""

import numpy as np
import pytest
from voxelforge.functions import kernels as K
from voxelforge.operators import coupled, lines
from voxelforge.operators.transforms import tile_map


def cells(spark, x, axes):
    rows = [(*map(int, i), float(v.real), float(v.imag)) for i, v in np.ndenumerate(x)]
    return spark.createDataFrame(rows, ", ".join(f"{a} int" for a in axes) + ", re double, im double")


def dense(df, axes, shape):
    out = np.zeros(shape, complex)
    for r in df.collect():
        out[tuple(r[a] for a in axes)] += r["re"] + 1j * r["im"]
    return out


@pytest.mark.parametrize("inverse", [False, True])
def test_volume(spark, inverse):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(8, 12, 10)) + 1j * rng.normal(size=(8, 12, 10))
    sizes = {"z": 8, "y": 12, "x": 10}
    for most, unitary in ((100, True), (5, False)):
        got = lines.fft(cells(spark, x, "zyx"), sizes, inverse, unitary, most=most)
        np.testing.assert_allclose(dense(got, "zyx", x.shape), K.fft(x, (0, 1, 2), inverse, unitary), atol=1e-8)


def test_long_line_in_factors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2, 4096)) + 1j * rng.normal(size=(2, 4096))
    df = cells(spark, x, ("i", "k"))
    for most, centred in ((64, True), (10, False)):
        got = lines.fft_axis(df, "k", 4096, unitary=True, centred=centred, most=most)
        np.testing.assert_allclose(dense(got, ("i", "k"), x.shape), K.fft(x, (1,), unitary=True, centred=centred), atol=1e-10)
    with pytest.raises(ValueError, match="no factor"):
        lines.fft_axis(df, "k", 4099, most=64)
    assert dense(lines.fft_axis(df.limit(0), "k", 4096, most=64), ("i", "k"), x.shape).any() == 0


def problem(spark, frames=5, n=6, items=3):
    """Every frame sees some lines of the spectrum only."""
    rng = np.random.default_rng(3)
    seen = rng.random((frames, n, 1)) < 0.6
    y = (rng.normal(size=(items, frames, n, n)) + 1j * rng.normal(size=(items, frames, n, n))) * seen
    right = K.fft(y, (-2, -1), inverse=True, unitary=True)
    rows = [(i, t, seen[t].astype(float).repeat(n).tolist(), v.real.ravel().tolist(), v.imag.ravel().tolist()) for i, vs in enumerate(right) for t, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "item int, t int, seen array<double>, re array<double>, im array<double>")
    sides = df.select("item", "t", "seen", df["seen"].alias("none")).cache()

    def encode(x):
        both = x.join(sides, ["item", "t"])
        masked = lambda v, m: K.fft(np.real(m) * K.fft(v, (1, 2), unitary=True), (1, 2), inverse=True, unitary=True)
        return tile_map(both, (n, n), masked, [("re", "im"), ("seen", "none")], [(n, n), (n, n)]).select("item", "t", "re", "im")

    f = np.stack([K.fft(e.reshape(n, n), (0, 1), unitary=True).ravel() for e in np.eye(n * n)], 1)
    blocks = [f.conj().T @ (seen[t].repeat(n)[:, None] * f) for t in range(frames)]
    return df.select("item", "t", "re", "im"), encode, blocks, right


def solved(df, shape):
    out = np.zeros(shape, complex)
    for r in df.collect():
        out[r["item"], r["t"]] = (np.array(r["re"]) + 1j * np.array(r["im"])).reshape(shape[2:])
    return out


@pytest.mark.parametrize("groups", [(), ("item",), ("item", "t")])
def test_separable_problem_is_that_of_every_tile(spark, groups):
    right, encode, blocks, b = problem(spark)
    got = solved(coupled.conjugate_gradients(right, encode, ["item", "t"], groups, 12, lam=0.3), b.shape)
    for t, a in enumerate(blocks):
        want = np.linalg.solve(a + 0.3 * np.eye(len(a)), b[:, t].reshape(len(b), -1).T).T
        np.testing.assert_allclose(got[:, t].reshape(len(b), -1), want, atol=1e-8)


def test_frames_are_coupled_and_plans_stay_flat(spark):
    right, encode, blocks, b = problem(spark)
    keys, depth = ["item", "t"], []

    def normal(x):
        depth.append(len(x._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        return coupled.added(encode(x), coupled.differences(x, "t", keys, 0.5), keys)

    got = solved(coupled.conjugate_gradients(right, normal, keys, ["item"], 60, lam=0.05), b.shape)
    frames, size = len(blocks), len(blocks[0])
    d = np.diff(np.eye(frames), axis=0)
    whole = np.kron(0.5 * d.T @ d, np.eye(size)).astype(complex) + 0.05 * np.eye(frames * size)
    for t, a in enumerate(blocks):
        whole[t * size : (t + 1) * size, t * size : (t + 1) * size] += a
    want = np.linalg.solve(whole, b.reshape(len(b), -1).T).T.reshape(b.shape)
    np.testing.assert_allclose(got, want, atol=1e-7)
    assert len(set(depth[1:])) == 1


def test_no_rows(spark):
    right, encode, _, _ = problem(spark)
    assert coupled.conjugate_gradients(right.limit(0), encode, ["item", "t"], ["item"], 5).count() == 0
