"""Sampled positions with repeats and padding."""

import numpy as np
from voxelforge.functions import kernels as K
from voxelforge.operators import positions as P


def problem(items=3, frames=4, shots=5, coils=3, image=(6, 5)):
    rng = np.random.default_rng(1)
    c = lambda *s: rng.normal(size=s) + 1j * rng.normal(size=s)
    lines = rng.integers(-1, image[0], (items, frames, shots))
    lines[0, 0, :5] = (2, 2, -1, 2, 5)
    lines[-1, 1] = -1
    return c(items, 2, *image), c(items, frames, shots, coils, image[1]), c(items, coils, *image), lines, c(2, frames)


def test_adjoint_pair_and_normal():
    x, y, maps, lines, basis = problem()
    ax = P.forward_lines(x, maps, lines, basis)
    assert (ax[lines < 0] == 0).all()
    np.testing.assert_allclose(np.vdot(ax, y), np.vdot(x, P.adjoint_lines(y, maps, lines, basis)))
    np.testing.assert_allclose(P.normal_lines(x, maps, P.line_kernel(lines, basis, 6)), P.adjoint_lines(ax, maps, lines, basis), atol=1e-10)


def test_every_line_once_is_the_pattern_form():
    x, _, maps, _, basis = problem(items=1)
    mask = np.zeros((4, 6, 5))
    lines = np.full((1, 4, 6), -1)
    for t in range(4):
        own = np.arange(t % 2, 6, 2)
        mask[t, own], lines[0, t, : len(own)] = 1, own
    full = K.subspace_forward(x, maps[0], mask, basis)
    got = P.forward_lines(x, maps, lines, basis)
    for t in range(4):
        for s, line in enumerate(lines[0, t]):
            if line >= 0:
                np.testing.assert_allclose(got[0, t, s], full[0, t, :, line])
    data = np.where(lines[..., None, None] >= 0, got, 7.0)  # padding is ignored
    np.testing.assert_allclose(P.adjoint_lines(data, maps, lines, basis), K.subspace_adjoint(full, maps[0], mask, basis), atol=1e-10)


def test_tables(spark):
    x, _, maps, lines, basis = problem(shots=9)
    for i in range(len(x)):
        lines[i, :, :6] = np.arange(6)
    flat = lambda v: (v.real.ravel().tolist(), v.imag.ravel().tolist())
    make = spark.createDataFrame
    images = make([(i, *flat(v)) for i, v in enumerate(x)], "item int, re array<double>, im array<double>")
    sides = (make([(i, *flat(v)) for i, v in enumerate(maps)], "item int, re array<double>, im array<double>"), ["item"]), (make([(i, v.ravel().tolist()) for i, v in enumerate(lines)], "item int, lines array<int>"), ["item"])
    size = (basis, 9, 3, (6, 5))
    data = P.forward(images, *sides, *size).drop("shape")
    for r in data.collect():
        np.testing.assert_allclose(np.array(r["re"]) + 1j * np.array(r["im"]), P.forward_lines(x, maps, lines, basis)[r["item"]].ravel(), atol=1e-10)
    for r in P.reconstruct(data, *sides, *size, steps=200).collect():
        np.testing.assert_allclose(np.array(r["re"]) + 1j * np.array(r["im"]), x[r["item"]].ravel(), atol=1e-4)
