"""Gridding, the circulant normal operator and reconstructions against explicit sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from voxelforge import model as M
from voxelforge.functions import gridding as G
from voxelforge.operators import noncartesian as N


def explicit(k, shape):
    """Rows of the transform."""
    e = np.ones((len(k), 1))
    for i, n in enumerate(shape):
        e = (e[:, :, None] * np.exp(-2j * np.pi * k[:, i : i + 1] * (np.arange(n) - n // 2) / n)[:, None, :]).reshape(len(k), -1)
    return e / np.sqrt(np.prod(shape))


def spokes(n, count, turn=0.0):
    t, r = turn + np.arange(count) * np.pi / count, np.arange(2 * n) / 2 - n / 2
    return np.stack([np.outer(np.sin(t), r).ravel(), np.outer(np.cos(t), r).ravel()], 1)


@pytest.mark.parametrize("shape", [(9,), (8, 11), (4, 6, 5)])
def test_gridding_is_the_sum(shape):
    rng = np.random.default_rng(1)
    k = (rng.random((40, len(shape))) - 0.5) * np.array(shape)
    x, y = rng.normal(size=(2, *shape)) + 1j * rng.normal(size=(2, *shape)), rng.normal(size=(2, 40)) + 1j * rng.normal(size=(2, 40))
    e = explicit(k, shape)
    for width, error in ((8, 1e-6), (14, 1e-11)):
        g = G.Grid(k, shape, width)
        np.testing.assert_allclose(g.forward(x), x.reshape(2, -1) @ e.T, atol=error * 10)
        np.testing.assert_allclose(g.adjoint(y).reshape(2, -1), y @ e.conj(), atol=error * 10)


@pytest.mark.parametrize("shape", [(12,), (8, 10), (4, 6, 5)])
def test_circulant_normal_is_the_product(shape):
    rng = np.random.default_rng(2)
    k, w = (rng.random((60, len(shape))) - 0.5) * np.array(shape), rng.random(60)
    x = rng.normal(size=(3, *shape)) + 1j * rng.normal(size=(3, *shape))
    e = explicit(k, shape)
    np.testing.assert_allclose(G.Toeplitz(w, k, shape)(x).reshape(3, -1), x.reshape(3, -1) @ e.T * w @ e.conj(), atol=1e-6)


def tables(spark, n=16, coils=4, count=40):
    """Two items with maps of their own and two trajectories."""
    rng = np.random.default_rng(3)
    ky, kx = np.mgrid[:n, :n] / n - 0.5
    items, maps, routes = [], [], []
    for i in range(4):
        x = rng.normal(size=(n, n)) + 1j * rng.normal(size=(n, n))
        items.append((i, i % 2, x.real.ravel().tolist(), x.imag.ravel().tolist()))
        m = np.stack([np.exp(-((ky - 0.5 * np.cos(c + i)) ** 2) - (kx - 0.5 * np.sin(c + i)) ** 2 + 1j * c * (ky + i * kx)) for c in range(coils)])
        maps.append((i, m.real.ravel().tolist(), m.imag.ravel().tolist()))
    for g in range(2):
        k = np.concatenate((spokes(n, count, 0.1 * g), np.stack([a.ravel() for a in np.mgrid[-n // 2 : n // 2, -n // 2 : n // 2]], 1) + 0.2 * g))
        w = 0.2 + np.hypot(*k.T) / n
        routes.append((g, [0.0] * len(k), k[:, 0].tolist(), k[:, 1].tolist(), w.tolist()))
    size = len(routes[0][1])
    make = spark.createDataFrame
    return (
        make(items, "item int, grp int, re array<double>, im array<double>"), (make(maps, "item int, re array<double>, im array<double>"), ["item"]),
        (make(routes, "grp int, kz array<double>, ky array<double>, kx array<double>, w array<double>"), ["grp"]), coils, size, (n, n),
    )


def stacked(df):
    return {r["item"]: np.array(r["re"]) + 1j * np.array(r["im"]) for r in df.collect()}


def test_tables_of_maps_and_trajectories(spark):
    images, maps, routes, *size = tables(spark)
    x, y = stacked(images), stacked(N.forward(images, maps, routes, *size))
    n = stacked(N.normal(images, maps, routes, *size))
    m = {r["item"]: (np.array(r["re"]) + 1j * np.array(r["im"])).reshape(4, -1) for r in maps[0].collect()}
    for i, r in enumerate(sorted(routes[0].collect()) * 2):
        e = explicit(np.stack((r["ky"], r["kx"]), 1), (16, 16)) * np.array(r["w"])[:, None]
        a = np.concatenate([e * c for c in m[i]])
        np.testing.assert_allclose(y[i], a @ x[i], atol=1e-6)
        np.testing.assert_allclose(n[i], a.conj().T @ (a @ x[i]), atol=1e-5)


def test_reconstruction_recovers_images(spark):
    images, maps, routes, *size = tables(spark)
    data = N.forward(images, maps, routes, *size).drop("shape")
    got, want = stacked(N.reconstruct(data, maps, routes, *size, steps=60)), stacked(images)
    for i in want:
        assert np.linalg.norm(got[i] - want[i]) < 1e-3 * np.linalg.norm(want[i])
    shrunk = stacked(N.reconstruct(data, maps, routes, *size, steps=60, l1=0.5))
    objective = lambda i, v, m, a: 0.5 * np.linalg.norm(a @ v - a @ want[i]) ** 2 + 0.5 * np.abs(v).sum()
    m = {r["item"]: (np.array(r["re"]) + 1j * np.array(r["im"])).reshape(4, -1) for r in maps[0].collect()}
    for i, r in enumerate(sorted(routes[0].collect()) * 2):
        e = explicit(np.stack((r["ky"], r["kx"]), 1), (16, 16)) * np.array(r["w"])[:, None]
        a = np.concatenate([e * c for c in m[i]])
        assert objective(i, shrunk[i], m, a) < objective(i, want[i], m, a)


def test_gridding_as_an_aggregate(spark):
    """Radial cells: the explicit adjoint, and no task of the sums with more than twice the median rows."""
    n, rng = 12, np.random.default_rng(4)
    routes = {f: spokes(n, 21, 0.3 * f) for f in range(3)}
    route = spark.createDataFrame([(f, s, float(a), float(b), 0.5 + s % 3) for f, k in routes.items() for s, (a, b) in enumerate(k)], "frame int, s int, ky double, kx double, w double")
    y = {(i, f): rng.normal(size=len(k)) + 1j * rng.normal(size=len(k)) for i in range(5) for f, k in routes.items()}
    samples = spark.createDataFrame([(i, f, s, float(v.real), float(v.imag)) for (i, f), ys in y.items() for s, v in enumerate(ys)], "item int, frame int, s int, re double, im double")
    got = N.grid_adjoint(samples, (route, ["frame", "s"]), ["item"], ["ky", "kx"], (n, n))
    for r in got.collect():
        want = sum((explicit(k, (n, n)) * (0.5 + np.arange(len(k)) % 3)[:, None]).conj().T @ y[r["item"], f] for f, k in routes.items())
        np.testing.assert_allclose(np.array(r["re"]) + 1j * np.array(r["im"]), want, atol=1e-5)
    cells = N.gridded(samples, (route, ["frame", "s"]), ["item"], ["ky", "kx"], (n, n)).repartition(8, "item", "gky", "gkx")
    counts = sorted(r["count"] for r in cells.groupBy(F.spark_partition_id()).count().collect())
    assert counts[-1] <= 2 * counts[len(counts) // 2]
    assert M.cells_to_tiles(cells.limit(0), ["item"], ["gky", "gkx"], [24, 24]).count() == 0


def test_gridding_shuffles_samples_and_no_grid(spark):
    """A key whose samples outnumber its cells, keys over many batches, a null key; the shuffle has fewer rows than samples."""
    n, rng, name = 6, np.random.default_rng(6), "spark.sql.execution.arrow.maxRecordsPerBatch"
    k = spokes(n, 30, 0.2)
    route = spark.createDataFrame([(s, float(a), float(b)) for s, (a, b) in enumerate(k)], "s int, ky double, kx double")
    ids = [None, *range(40)]
    y = {i: rng.normal(size=len(k)) + 1j * rng.normal(size=len(k)) for i in ids}
    samples = spark.createDataFrame([(i, s, float(v.real), float(v.imag)) for i in ids for s, v in enumerate(y[i])], "item int, s int, re double, im double")
    before = spark.conf.get(name)
    try:
        for size in (7, 10_000):
            spark.conf.set(name, size)
            got = N.grid_adjoint(samples, (route, ["s"]), ["item"], ["ky", "kx"], (n, n), route_rows=len(k))
            assert "Aggregate" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Generate" not in plan
            rows = got.collect()
            assert sorted(r["item"] or -1 for r in rows) == sorted(i or -1 for i in ids)
            for r in rows:
                np.testing.assert_allclose(np.array(r["re"]) + 1j * np.array(r["im"]), explicit(k, (n, n)).conj().T @ y[r["item"]], atol=1e-4)
    finally:
        spark.conf.set(name, before)
