"""Raw arrays in ranges and slabs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from voxelforge.sources import bundle, cfl, slabs


def arrays(seed=1):
    rng = np.random.default_rng(seed)
    shapes = {"a": (3, 5, 7), "b": (101,), "c": (1, 4), "d": (2, 3, 4, 5)}
    return {n: (rng.normal(size=s) + 1j * rng.normal(size=s)).astype("<c8") for n, s in shapes.items()}


def put(folder, some):
    for name, x in some.items():
        (folder / f"{name}.hdr").write_text(cfl.format_header(list(x.shape[::-1])))
        (folder / f"{name}.cfl").write_bytes(x.tobytes())


@pytest.mark.parametrize("values", [1, 15, 23, 10_000])
def test_ranges_give_the_whole_file(spark, tmp_path, values):
    some = arrays()
    put(tmp_path, some)
    df = slabs.read_slabs(spark, f"file://{tmp_path}", 8 * values, 11)
    assert df.rdd.getNumPartitions() == len(slabs.plan([(n, x.shape[::-1], n) for n, x in some.items()], values))
    got = {n: np.full(x.size, np.nan, complex) for n, x in some.items()}
    for r in df.collect():
        assert len(r["re"]) <= min(values, 11)
        assert tuple(r["shape"]) == some[r["array_id"]].shape or r["array_id"] == "c"
        got[r["array_id"]][r["start"] : r["start"] + len(r["re"])] = np.array(r["re"]) + 1j * np.array(r["im"])
    assert all((got[n] == x.ravel()).all() for n, x in some.items())


def test_plan_covers_every_value_once():
    rng = np.random.default_rng(2)
    sizes = [(str(i), (int(n),), "") for i, n in enumerate(rng.integers(1, 200, 50))]
    parts = slabs.plan(sizes, 70)
    assert all(0 < sum(p[4] for p in r.pieces) <= 70 for r in parts)
    seen = [(p[0], v) for r in parts for p in r.pieces for v in range(p[3], p[3] + p[4])]
    assert len(seen) == len(set(seen)) == sum(s[1][0] for s in sizes)


def test_wrong_sizes_raise(spark, tmp_path):
    put(tmp_path, arrays())
    (tmp_path / "b.cfl").write_bytes(b"0" * 80)
    with pytest.raises(Exception, match="80 bytes for dimensions"):
        slabs.read_slabs(spark, f"file://{tmp_path}").count()


def test_slabs_are_written_in_any_order(spark, tmp_path):
    some = arrays(3)
    rows = [(n, list(x.shape), a, x.ravel()[a : a + 9].real.tolist(), x.ravel()[a : a + 9].imag.tolist()) for n, x in some.items() for a in range(0, x.size, 9)]
    df = spark.createDataFrame(rows + rows[:3], slabs.SLAB).repartition(5, F.rand(1))
    sizes = {r["array_id"]: r["bytes"] for r in slabs.write_slabs(df, f"file://{tmp_path}").collect()}
    assert sizes == {n: 8 * x.size for n, x in some.items()}
    for n, x in some.items():
        assert (np.fromfile(tmp_path / f"{n}.cfl", "<c8") == x.ravel()).all()
    cells = slabs.slabs_to_cells(slabs.read_slabs(spark, f"file://{tmp_path}", 100), ["z", "y", "x"]).where("array_id = 'a'").toPandas()
    assert len(cells) == some["a"].size
    np.testing.assert_allclose(cells["re"], some["a"].real[cells["z"], cells["y"], cells["x"]])
    with pytest.raises(Exception, match="instead of"):
        slabs.write_slabs(df.where("start <> 9"), f"file://{tmp_path}").collect()


def test_folder_without_arrays_is_empty(spark, tmp_path):
    assert slabs.read_slabs(spark, f"file://{tmp_path}").count() == 0


def test_bundle_of_named_arrays(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i % 5}", [float(i)]) for i in range(40)], "item int, name string, re array<double>")
    bundle.write_bundle(df, f"{tmp_path}/b", "name")
    assert bundle.read_bundle(spark, f"{tmp_path}/b", "name").count() == 40
    some = bundle.read_bundle(spark, f"{tmp_path}/b", "name", ["n1", "n3"])
    assert {r["item"] for r in some.collect()} == {i for i in range(40) if i % 5 in (1, 3)}
    assert "PartitionFilters: [name" in some._jdf.queryExecution().toString()


def test_grey_and_channels(spark):
    df = spark.createDataFrame([(0, 0, 3.0, 4.0), (0, 1, 0.0, 1.0), (1, 0, 0.0, 0.0)], "item int, x int, re double, im double")
    assert {(r["item"], r["x"]): r["grey"] for r in bundle.grey(df, ["item"]).collect()} == {(0, 0): 255, (0, 1): int(255 / 3.75), (1, 0): 0}
    assert sorted(map(tuple, bundle.as_complex(bundle.as_channels(df)).collect())) == sorted(map(tuple, df.collect()))
    assert tuple(bundle.as_complex(bundle.as_channels(df).where("part = 0")).where("item = 0 AND x = 0").first())[2:] == (3.0, 0.0)
