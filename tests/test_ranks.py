"""Ranks and order statistics of large groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from voxelforge.operators import ranks as R


@pytest.fixture(scope="module")
def table(spark):
    """One group of most rows, ties, a group of one row, null keys, tiny and huge values."""
    rng = np.random.default_rng(1)
    rows = [("big", i, float(v)) for i, v in enumerate(np.concatenate((rng.lognormal(0, 5, 3000), np.repeat(2.5, 1500), [0.0] * 200)))]
    rows += [("one", 9001, 7.0), ("tie", 9002, 1.0), ("tie", 9003, 1.0)] + [(None, 9100 + i, float(i % 3)) for i in range(10)] + [("wide", 9200 + i, v) for i, v in enumerate((-1e308, 1e308, 5e-324, 0.0, 1.0))]
    return spark.createDataFrame(rows, "g string, i long, v double").repartition(6, "i").cache(), rows


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_ranks_are_those_of_the_order(table, parts):
    df, rows = table
    got = {r["i"]: (r["rank"], r["n"], r["b"]) for r in R.ranks(df, ["g"], ["v", "i"], total="n", parts=parts).withColumn("b", R.tiles(F.col("rank"), F.col("n"), 4)).collect()}
    for g in {r[0] for r in rows}:
        own = sorted((v, i) for k, i, v in rows if k == g)
        cut = np.concatenate([np.full(len(p), b) for b, p in enumerate(np.array_split(np.arange(len(own)), 4))])
        for n, (_, i) in enumerate(own):
            assert got[i] == (n, len(own), cut[n])


def test_no_task_holds_the_group(table):
    df, _ = table
    dealt = df.repartitionByRange(8, "g", "v", "i").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < 0.3 * df.count()


def test_order_statistics(table):
    df, rows = table
    places = {"first": F.lit(0), "mid": F.floor(F.col("n") / 2), "last": F.col("n") - 1, "far": F.lit(4000)}
    got = {r["g"]: r for r in R.order_statistics(df.where("g IS NOT NULL"), ["g"], "v", places).collect()}
    for g in ("big", "one", "tie", "wide"):
        own = sorted(v for k, _, v in rows if k == g)
        assert [got[g][k] for k in ("n", "first", "mid", "last", "far")] == [len(own), own[0], own[len(own) // 2], own[-1], own[4000] if len(own) > 4000 else None]


def test_quantiles(table):
    df, rows = table
    for groups in (["g"], []):
        got = R.quantiles(df.where("g IN ('big', 'tie', 'one')"), groups, "v", {"a": 0.5, "b": 0.9}).collect()
        for r in got:
            own = [v for k, _, v in rows if (k == r["g"] if groups else k in ("big", "tie", "one"))]
            np.testing.assert_allclose([r["a"], r["b"], r["top"]], [*np.quantile(own, (0.5, 0.9)), max(own)], rtol=1e-12)
    assert R.quantiles(df.limit(0), ["g"], "v", {"a": 0.5}).count() == 0


def test_intervals_of_many_groups_are_not_sent_to_the_driver(spark, monkeypatch):
    """Only a declared, small number of groups is broadcast by name; groups of unknown number are not."""
    from voxelforge.operators import ranks as R

    named, small = [], R.small
    monkeypatch.setattr(R, "small", lambda df, rows: named.append(rows) or small(df, rows))
    df = spark.range(200).selectExpr("id % 7 AS g", "CAST(id * id % 31 AS DOUBLE) AS v")
    got = {r["g"]: r["q"] for r in R.quantiles(df, ["g"], "v", {"q": 0.5}).collect()}
    assert not named
    import numpy as np

    for g in range(7):
        assert got[g] == np.quantile([float(i * i % 31) for i in range(200) if i % 7 == g], 0.5)
