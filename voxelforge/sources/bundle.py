"""Many named arrays in one folder, grey images and separate channels of complex values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.elementwise import modulus


def write_bundle(tiles: DataFrame, folder: str, name: str) -> None:
    """Write tiles under the array that they belong to; tasks write what they have, so one array may span many files."""
    tiles.write.partitionBy(name).parquet(folder)


def read_bundle(spark: SparkSession, folder: str, name: str, only: Sequence | None = None) -> DataFrame:
    """All arrays of a bundle in one scan, or the folders of the named ones only."""
    every = spark.read.parquet(folder)
    return every if only is None else every.where(F.col(name).isin(list(only)))


def grey(cells: DataFrame, item: Sequence[str], levels: int = 256, window: float = 0.75) -> DataFrame:
    """Column ``grey``: magnitudes from 0 to the share ``window`` of the item's largest one as whole levels."""
    x = cells.withColumn("__a", modulus())
    top = x.groupBy(*item).agg(F.max("__a").alias("__m"))
    level = F.when(F.col("__m") == 0, 0).otherwise(F.least(F.lit(levels - 1), F.floor((levels - 1) * F.col("__a") / (window * F.col("__m")))))
    return x.join(top, list(item)).withColumn("grey", level.cast("int")).drop("__a", "__m")


def as_channels(cells: DataFrame, part: str = "part", value: str = "v") -> DataFrame:
    """Two rows a cell: the real part (0) and the imaginary one (1)."""
    rest = [c for c in cells.columns if c not in ("re", "im")]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("p"), F.col(c).alias("v")) for i, c in enumerate(("re", "im"))))).alias("__e")
    return cells.select(*rest, each).select(*rest, F.col("__e.p").alias(part), F.col("__e.v").alias(value))


def as_complex(channels: DataFrame, part: str = "part", value: str = "v") -> DataFrame:
    """Inverse of ``as_channels``; an absent part is zero."""
    rest = [c for c in channels.columns if c not in (part, value)]
    pick = lambda i: F.sum(F.when(F.col(part) == i, F.col(value)).otherwise(0.0))
    return channels.groupBy(*rest).agg(pick(0).alias("re"), pick(1).alias("im"))
