"""Tiles of any size and shape, and reconstructions with maps and patterns of every item."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_kernels import birdcage
from voxelforge import model as M
from voxelforge.functions import kernels as K
from voxelforge.operators import calib as C
from voxelforge.operators import recon as B
from voxelforge.operators import reduce as A
from voxelforge.operators import transforms as T

RNG = np.random.default_rng(5)
TILE = "id long, shape array<int>, re array<double>, im array<double>"


def cplx(*shape):
    return RNG.standard_normal(shape) + 1j * RNG.standard_normal(shape)


def tiles(spark, arrays):
    return spark.createDataFrame([(i, list(x.shape), x.real.ravel().tolist(), np.imag(x).ravel().tolist()) for i, x in enumerate(arrays)], TILE)


def back(df):
    return {r["id"]: (np.array(r["re"]) + 1j * np.array(r["im"])).reshape(r["shape"]) for r in df.collect()}


def test_gather_of_large_tiles_adds_repeated_cells_and_leaves_out_others(spark):
    n = 256
    cells = spark.range(2 * n * n).select((F.col("id") % 2).alias("k"), (F.floor(F.col("id") / 2) % n).cast("int").alias("y"), F.floor(F.col("id") / (2 * n)).cast("int").alias("x"), F.lit(1.0).alias("re"), F.lit(-1.0).alias("im"))
    more = spark.createDataFrame([(0, 3, 4, 2.0, 0.0), (0, 3, 4, 5.0, 0.0), (0, -1, 4, 9.0, 9.0), (0, 0, n, 9.0, 9.0)], cells.schema)
    got = M.cells_to_tiles(cells.union(more), ["k"], ["y", "x"], [n, n])
    sums = {r["k"]: (r["a"], r["b"], r["c"]) for r in got.select("k", F.aggregate("re", F.lit(0.0), lambda a, v: a + v).alias("a"), F.get("re", F.lit(3 * n + 4)).alias("b"), F.size("im").alias("c")).collect()}
    assert sums == {0: (n * n + 7.0, 8.0, n * n), 1: (float(n * n), 1.0, n * n)}


def test_transform_of_mixed_shapes_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(M, "PIECE_BYTES", 5000)
    arrays = [cplx(8, 8), cplx(4, 16), cplx(5), cplx(8, 8), cplx(3, 4, 5), cplx(64, 64)]
    got = back(T.fft(tiles(spark, arrays), None, unitary=True))
    for i, x in enumerate(arrays):
        assert np.allclose(got[i], K.fft(x[None], tuple(range(1, x.ndim + 1)), unitary=True)[0])


def test_gram_is_the_product(spark):
    x = cplx(50, 6)
    df = spark.createDataFrame([(i, j, float(x[i, j].real), float(x[i, j].imag)) for i in range(50) for j in range(6) if (i, j) != (3, 2)], "s int, c int, re double, im double")
    x[3, 2] = 0
    g = T.to_matrix(A.channel_gram(df.repartition(5), "s", "c", 6, mean=False).collect(), 6)
    assert np.allclose(g, x.T @ x.conj())


@pytest.fixture(scope="module")
def study(spark):
    """Two items with maps and patterns of their own."""
    maps = [birdcage(4, (16, 16)), np.roll(birdcage(4, (16, 16)), 1, 0) * np.exp(0.3j)]
    masks = [np.ones((16, 16)), np.ones((16, 16))]
    masks[0][1::4] = 0
    masks[1][:, 2::4] = 0
    images = [cplx(16, 16), cplx(16, 16)]
    y = [K.sense_forward(x[None], m, p)[0] for x, m, p in zip(images, maps, masks, strict=True)]
    return images, maps, masks, tiles(spark, y), (tiles(spark, maps), ["id"]), (tiles(spark, masks), ["id"])


def test_every_item_has_its_own_maps_and_pattern(study):
    images, maps, masks, y, own, pattern = study
    got = back(B.sense_adjoint(y, own, pattern))
    for i in (0, 1):
        want = K.sense_adjoint(K.sense_forward(images[i][None], maps[i], masks[i]), maps[i], masks[i])[0]
        assert np.allclose(got[i], want)
    got = back(B.cg_sense(y, own, pattern, 300))
    for i in (0, 1):
        assert np.allclose(got[i], images[i], atol=1e-3)
    fixed = back(B.cg_sense(y.where("id = 0"), maps[0], masks[0], 300))
    assert np.allclose(fixed[0], got[0], atol=1e-5)


def test_solvers_lower_what_they_minimise(study):
    _, maps, masks, y, own, pattern = study
    zero = back(B.sense_adjoint(y, own, pattern))
    data = back(y)
    tv = lambda x, i: 0.5 * (np.abs(masks[i] * K.sense_forward(x[None], maps[i], masks[i]) - data[i]) ** 2).sum() + 0.05 * np.abs(K.grad(x[None])).sum()
    for df in (B.admm_tv(y, own, pattern, 0.05, steps=60), B.primal_dual(y, own, pattern, 0.05, steps=400)):
        got = back(df)
        for i in (0, 1):
            assert tv(got[i], i) < tv(zero[i], i)
    a, b = back(B.admm_tv(y, own, pattern, 0.05, steps=100)), back(B.primal_dual(y, own, pattern, 0.05, steps=800))
    assert all(abs(tv(a[i], i) - tv(b[i], i)) < 0.01 * tv(a[i], i) for i in (0, 1))
    l1 = lambda x, i: 0.5 * (np.abs(K.sense_forward(x[None], maps[i], masks[i]) - data[i]) ** 2).sum() + 0.05 * np.abs(K.fwt(x[None], (1, 2), "haar")).sum()
    got = back(B.pics(y, own, pattern, 0.05, 60, wavelet="haar", eigen_step=True))
    assert all(l1(got[i], i) < l1(zero[i], i) for i in (0, 1))


def test_projections_keep_measured_lines_and_nlinv_gives_coils(study):
    _, _, masks, y, own, pattern = study
    data = back(y)
    for i, k in back(B.pocsense(y, own, pattern, 5)).items():
        assert np.allclose(k * masks[i], data[i] * masks[i])
    for k in back(B.nlinv(y, pattern, coils=True)).values():
        assert k.shape == (5, 16, 16) and np.allclose((np.abs(k[1:]) ** 2).sum(0), 1)


def test_calibration_gives_maps_of_every_item(study):
    images, maps, _, y, *_ = study
    full = [K.sense_forward((1 + 0 * x)[None], m, np.ones((16, 16)))[0] for x, m in zip(images, maps, strict=True)]
    df = tiles(y.sparkSession, full)
    for made in (C.caldir(df, 8), C.walsh(df), C.ecalib(df, 5, 0.001, 0.8, calibration=12)):
        for i, m in back(made).items():
            norm = (np.abs(m) ** 2).sum(0)
            assert np.all(np.isclose(norm, 1) | np.isclose(norm, 0))
            inner = np.abs((np.conj(m) * maps[i]).sum(0))[2:-2, 2:-2]
            assert np.median(inner) > 0.9
    assert {m.shape for m in back(C.ecalib(df, 3, sets=2, soft_weight=True)).values()} == {(2, 4, 16, 16)}
    kernels = C.maps_to_kernels(df, 16)
    for i, m in back(C.kernels_to_maps(kernels, (16, 16))).items():
        assert np.allclose(m, full[i])


def test_low_rank_of_sizes_that_are_no_multiple_of_the_block(spark):
    x = cplx(3, 5, 7)
    df = spark.createDataFrame([(0, t, x[t].real.ravel().tolist(), x[t].imag.ravel().tolist()) for t in range(3)], "k long, t int, re array<double>, im array<double>")
    got = {r["t"]: np.array(r["re"]).reshape(5, 7) for r in B.locally_low_rank(df, "k", "t", (5, 7), 4, 0.0).collect()}
    assert all(np.allclose(got[t], x[t].real) for t in got)


def test_field_correction_is_adjoint(spark):
    before, after = [cplx(8, 8), cplx(8, 8)], [cplx(8, 8), cplx(8, 8)]
    x, y = cplx(3, 8, 8), cplx(3, 8, 8)
    ax, ay = back(B.field_corrected(tiles(spark, [x]), None, before, after))[0], back(B.field_corrected(tiles(spark, [y]), None, before, after, adjoint=True))[0]
    assert np.isclose(np.vdot(ax, y), np.vdot(x, ay))


def test_subspace_coefficients_are_recovered(spark):
    maps, basis = birdcage(3, (8, 8)), np.linalg.qr(RNG.standard_normal((6, 2)))[0].T
    mask = np.ones((6, 8, 8))
    mask[::2, 1::4] = 0
    x = cplx(2, 8, 8)
    y = K.subspace_forward(x[None], maps, mask, basis)[0]
    assert np.allclose(back(B.subspace_cg(tiles(spark, [y]), (6, 3, 8, 8), maps, mask, basis, 200))[0], x, atol=1e-3)
    k = RNG.uniform(-4, 4, (30, 2))
    s, v = back(T.nufft(tiles(spark, [x]), (2, 8, 8), k, basis=basis))[0], cplx(6, 30)
    assert np.isclose(np.vdot(s, v), np.vdot(x, back(T.nufft_adjoint(tiles(spark, [v]), (8, 8), k, basis=basis))[0]))


def test_long_series_are_cut_into_stretches(spark, monkeypatch):
    from voxelforge.operators import windows as W

    x = M.signal(spark, "/root/testdata/sf0.001")
    calls = (lambda: W.moving_average(x, ["ch"], "i", 5), lambda: W.median_filter(x, ["ch"], "i", 4), lambda: W.unwrap(x, ["ch"], "i", 20.0), lambda: W.geometric_median(x, ["ch"], "i", 5))
    take = lambda f: sorted((r["ch"], r["i"], round(r["re"], 6)) for r in f().collect())
    whole = [take(f) for f in calls]
    for n in (1, 3, 7):
        monkeypatch.setattr(W, "STRETCH", n)
        assert [take(f) for f in calls] == whole


def test_subspace_projection_groups_no_rows(spark):
    from voxelforge.jobs.queries import QUERIES

    path = "/root/testdata/sf0.001"
    got = QUERIES["b11_subspace"](spark, path)
    assert "Aggregate" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning" not in plan
    cells = lambda df, i: {(r["p_partkey"], r[i]): r["re"] for r in df.collect()}
    echoes = cells(M.echo(spark, path), "e")
    keys = sorted({k for k, _ in echoes})
    x = np.array([[echoes[k, e] for e in range(1, 9)] for k in keys])
    assert np.array_equal(np.array([r["re"] for r in M.echo_tiles(spark, path).orderBy("p_partkey").collect()]), x)
    v = np.linalg.svd(x)[2][:3]
    want, found = x @ v.T @ v, cells(got, "v")
    assert len(found) == want.size
    assert np.allclose([[found[k, e] for e in range(8)] for k in keys], want, atol=1e-5)


def test_channels_of_cells_are_summed_where_their_rows_are_dealt(spark):
    x, m = cplx(40, 6), cplx(3, 6)
    df = spark.createDataFrame([(i, j, float(x[i, j].real), float(x[i, j].imag)) for i in range(40) for j in range(6)], "s int, c int, re double, im double")
    got = T.apply_channels(df, m, "s", "c")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("hashpartitioning") == 1
    y = np.zeros((40, 3), complex)
    for r in got.collect():
        y[r["s"], r["v"]] = r["re"] + 1j * r["im"]
    assert np.allclose(y, x @ m.T)
    assert M.dealt(df, "s", 10, count=400).rdd.getNumPartitions() == 40
    assert "REPARTITION_BY_NUM" in A.channel_gram(df, "s", "c", 6)._jdf.queryExecution().executedPlan().toString()
