"""Every query with SQL gives the SQL's rows; every other one gives some."""

import pytest
from conftest import DATA, same
from voxelforge.jobs.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    assert len(got)
    if name in ORACLES:
        same(got, duck.sql(ORACLES[name]).df())


def test_entry_without_the_training_data_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
