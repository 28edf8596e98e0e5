"""Conjugate gradients over a table whose rows are coupled by Spark operations.

The state is one table of tiles, a row per item and frame: the solution, the residual and the direction.  A step
applies the normal operator, which may join and aggregate over rows at will, takes one aggregate per dot product
and writes the new state to the shared folder, so plans stay as deep as one step and a lost executor costs one.
Independent problems are told apart by ``groups`` columns and share their steps; their scalars are a
table of a row per group, which is joined and never collected.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_folder
from .joins import small


def dot(a: str, b: str) -> Column:
    """Real part of <a, b> of a row's arrays a_re, a_im, b_re, b_im."""
    pair = lambda p: F.aggregate(F.zip_with(f"{a}_{p}", f"{b}_{p}", lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return pair("re") + pair("im")


def axpy(x: str | Column, factor: Column, y: str | Column) -> Column:
    """x + factor y, array by array."""
    return F.zip_with(x, y, lambda u, v: u + factor * v)


class Written:
    """Tables in the shared folder: each forgets how it was made, and those of two steps ago are removed.

    (Checkpoints would keep the constraints of their plans, which grow from step to step.)
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.names = spark, f"{shared_folder(spark)}/solver-{uuid.uuid4().hex}", []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.names)}"
        df.write.parquet(path)
        self.names.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, before: int) -> None:
        for i, path in enumerate(self.names[:before]):
            if path:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
                self.names[i] = ""


def conjugate_gradients(right: DataFrame, normal: Callable[[DataFrame], DataFrame], keys: Sequence[str], groups: Sequence[str] = (), steps: int = 30, lam: float = 0.0, tolerance: float = 1e-10, group_rows: int = 100_000) -> DataFrame:
    """Solve (normal + lam) x = right for tiles (keys, re, im); gives (keys, re, im).

    ``normal`` maps a table of tiles (keys, re, im) to one of the same keys.  ``groups``, some of the keys, name independent
    problems; the table of their scalars is broadcast up to ``group_rows`` declared rows.  Steps end when
    every group's residual is below ``tolerance`` times its right side.
    """
    none = lambda c: F.transform(c, lambda v: v * 0.0)
    parts = [f"{v}_{p}" for v in ("x", "r", "p") for p in ("re", "im")]
    state = right.select(*keys, none("re").alias("x_re"), none("im").alias("x_im"), F.col("re").alias("r_re"), F.col("im").alias("r_im"), F.col("re").alias("p_re"), F.col("im").alias("p_im"))
    files = Written(right.sparkSession)
    state = files.keep(state)
    by = list(groups)

    def scalars(df: DataFrame, value: Column, name: str) -> DataFrame:
        return df.groupBy(*by).agg(F.sum(value).alias(name))

    def with_scalars(df: DataFrame, table: DataFrame) -> DataFrame:
        table = small(table, group_rows if by else 1)
        return df.join(table, by) if by else df.crossJoin(table)  # one row where all is one problem

    first = scalars(state, dot("r", "r"), "rr").withColumn("enough", F.col("rr") * tolerance**2)
    residual = files.keep(first)
    for _ in range(steps):
        done = len(files.names)
        if residual.where("rr > enough").isEmpty():
            break
        q = normal(state.select(*keys, F.col("p_re").alias("re"), F.col("p_im").alias("im")))
        q = q.select(*keys, F.col("re").alias("q_re"), F.col("im").alias("q_im"))
        both = files.keep(state.join(q, list(keys)).withColumns({f"q_{p}": axpy(f"q_{p}", F.lit(lam), f"p_{p}") for p in ("re", "im")}))
        curve = scalars(both, dot("p", "q"), "pq")
        alpha = F.when((F.col("rr") > F.col("enough")) & (F.col("pq") > 0), F.col("rr") / F.col("pq")).otherwise(0.0)
        size = (residual.join(curve, by) if by else residual.crossJoin(curve)).withColumn("alpha", alpha).drop("pq")
        moved = with_scalars(both, size)
        moved = moved.withColumns({f"x_{p}": axpy(f"x_{p}", F.col("alpha"), f"p_{p}") for p in ("re", "im")} | {f"r_{p}": axpy(f"r_{p}", -F.col("alpha"), f"q_{p}") for p in ("re", "im")})
        moved = files.keep(moved.select(*keys, *parts))
        after = scalars(moved, dot("r", "r"), "new")
        residual = files.keep((size.join(after, by) if by else size.crossJoin(after)).select(*by, F.col("new").alias("rr"), "enough", F.when(F.col("alpha") > 0, F.col("new") / F.col("rr")).otherwise(0.0).alias("beta")))
        files.forget(done)
        state = with_scalars(moved, residual.select(*by, "beta"))  # from tables that are written: two joins deep at any step
        state = state.withColumns({f"p_{p}": axpy(f"r_{p}", F.col("beta"), f"p_{p}") for p in ("re", "im")}).select(*keys, *parts)
    return state.select(*keys, F.col("x_re").alias("re"), F.col("x_im").alias("im"))


def differences(tiles: DataFrame, frame: str, keys: Sequence[str], weight: float) -> DataFrame:
    """weight D^H D over the frames of each item, D x = x[t + 1] - x[t]: rows meet their neighbours by an equi-join."""
    own = [k for k in keys if k != frame]
    near = lambda step, name: tiles.select(*own, (F.col(frame) + step).alias(frame), F.col("re").alias(f"{name}_re"), F.col("im").alias(f"{name}_im"))
    both = tiles.join(near(1, "a"), [*own, frame], "left").join(near(-1, "b"), [*own, frame], "left")

    def value(p: str) -> Column:
        gap = lambda n: F.when(F.col(f"{n}_{p}").isNull(), F.transform(p, lambda v: v * 0.0)).otherwise(F.zip_with(p, f"{n}_{p}", lambda u, v: u - v))
        return F.zip_with(gap("a"), gap("b"), lambda u, v: weight * (u + v))

    return both.select(*keys, value("re").alias("re"), value("im").alias("im"))


def added(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row by row sum of two tables of tiles."""
    b = b.select(*keys, F.col("re").alias("__re"), F.col("im").alias("__im"))
    return a.join(b, list(keys)).select(*keys, axpy("re", F.lit(1.0), "__re").alias("re"), axpy("im", F.lit(1.0), "__im").alias("im"))
