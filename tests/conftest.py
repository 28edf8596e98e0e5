import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return con


def same(got, want):
    """Equal rows whatever their order, doubles to six digits."""

    def norm(x):
        x = x.reindex(columns=sorted(x.columns)).copy()
        for c in x.columns:
            if x[c].dtype == float:
                x[c] = x[c].round(6) + 0.0
        return x.astype(str).sort_values(list(x.columns)).reset_index(drop=True)

    a, b = norm(got), norm(want)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    assert a.equals(b), a[(a != b).any(axis=1)].head().to_string()
