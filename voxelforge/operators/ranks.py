"""Ranks and order statistics of groups that exceed a task."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import shared_folder
from .joins import small

#: Bins of a round of refinement.
BINS = 1024


def _written(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/ranks-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranks(df: DataFrame, rest: Sequence[str], order: Sequence[Column | str], name: str = "rank", total: str | None = None, parts: int | None = None) -> DataFrame:
    """Number the rows of every group from 0 in a total order, whatever the size of a group.

    Rows are dealt to ranges of (group, order), so one group may span many tasks; a range counts its rows by group, the
    counts of the ranges before are added, and only these counts are in one window.  ``total`` adds the group's size.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"__o{i}" for i in range(len(order))]
    wide = df.withColumns({k: F.col(o) if isinstance(o, str) else o for k, o in zip(keys, order, strict=True)})
    dealt = _written(wide.repartitionByRange(parts, *rest, *keys).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy(*rest, "__part").agg(F.count("*").alias("__n"))
    by = Window.partitionBy(*rest)
    before = counts.withColumns({"__before": F.sum("__n").over(by.orderBy("__part")) - F.col("__n"), "__total": F.sum("__n").over(by)}).drop("__n")
    local = dealt.withColumn("__own", F.row_number().over(Window.partitionBy(*rest, "__part").orderBy(*keys)) - 1)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*rest, "__part")]
    both = local.alias("l").join(before.alias("b"), same)
    return both.select(*(F.col(f"l.{c}") for c in df.columns), (F.col("__own") + F.col("__before")).alias(name), *([F.col("__total").alias(total)] if total else []))


def tiles(rank: Column, total: Column, bins: int) -> Column:
    """Bin of a rank when a group is dealt to bins as evenly as can be, larger bins first."""
    size, large = F.floor(total / bins), total % bins
    edge = large * (size + 1)
    return F.when(rank < edge, F.floor(rank / (size + 1))).otherwise(large + F.floor((rank - edge) / F.greatest(size, F.lit(1)))).cast("int")


def order_statistics(df: DataFrame, groups: Sequence[str], value: str, places: dict[str, Column], group_rows: int | None = None) -> DataFrame:
    """The values at given places (from 0, as expressions of the group's size ``n``) in each group's ascending order.

    Every round takes a histogram of the interval that still holds a place, one aggregate for all groups and places,
    and goes on with the least and the largest value of the bin that the place falls in, until these are equal.  Values
    are never gathered: a task keeps counts of bins, and a group may be the whole table.  Values must be finite; nulls take no part; a place outside a
    group gives null.  The table of intervals, a row per group and place, is broadcast if its rows are declared and few.
    """
    by = list(groups)
    data = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    first = data.groupBy(*by).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("place"), p.cast("long").alias("k")) for k, p in places.items())))
    state = _written(first.select(*by, "n", "lo", "hi", each.alias("__e")).select(*by, "__e.place", "__e.k", F.lit(0).cast("long").alias("below"), "lo", "hi", "n").where("k >= 0 AND k < n"))
    found = state.where("lo = hi")
    open_ = state.where("lo < hi")
    done = [found]
    while not open_.isEmpty():
        side = open_ if by and group_rows is None else small(open_, group_rows or len(places))
        both = data.join(side, by) if by else data.crossJoin(side)  # as many rows as places where all is one group
        inside = both.where(F.col("__v").between(F.col("lo"), F.col("hi")))
        share = F.coalesce(F.try_divide(F.col("__v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2), F.lit(0.0))  # halves: differences stay finite
        bins = inside.withColumn("bin", F.when(F.col("__v") == F.col("hi"), BINS).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1))))
        hist = bins.groupBy(*by, "place", "k", "below", "n", "bin").agg(F.count("*").alias("m"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        upto = F.sum("m").over(Window.partitionBy(*by, "place").orderBy("bin"))
        hit = hist.withColumn("upto", F.col("below") + upto).where((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("m")))
        state = _written(hit.select(*by, "place", "k", (F.col("upto") - F.col("m")).alias("below"), "lo", "hi", "n"))
        done.append(state.where("lo = hi"))
        open_ = state.where("lo < hi")
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    got = every.groupBy(*by).pivot("place", list(places)).agg(F.first("lo"))
    return first.select(*by, "n").join(got, by, "left") if by else first.select("n").crossJoin(got)


def quantiles(df: DataFrame, groups: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles between the two values next to each place, by name; with the group's size ``n`` and largest value ``top``."""
    at = lambda p: p * (F.col("n") - 1)
    places = {f"{k}_{side}": f(at(p)) for k, p in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))} | {"top": F.col("n") - 1}
    got = order_statistics(df, groups, value, places)
    line = lambda k, p: F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * (at(p) - F.floor(at(p)))
    return got.select(*groups, "n", "top", *(line(k, p).alias(k) for k, p in shares.items()))
