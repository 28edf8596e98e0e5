"""Reductions, norms, metrics and region statistics.  Sizes come from the declared shape, as absent cells are zero."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import cells_to_tiles, dealt, small_batches
from .elementwise import modulus
from .ranks import quantiles, ranks


def energy() -> Column:
    return F.col("re") * F.col("re") + F.col("im") * F.col("im")


def total(df: DataFrame, kept: Sequence[str], divisor: float = 1.0) -> DataFrame:
    """Sum over the other axes, divided by ``divisor`` (the size for a mean, its root for the scaled sum)."""
    return df.groupBy(*kept).agg((F.sum("re") / divisor).alias("re"), (F.sum("im") / divisor).alias("im"))


def weighted_mean(df: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Mean over the cells that are not zero (our reading of a weighted average); zero if there are none."""
    n = F.sum((energy() != 0).cast("double"))
    return df.groupBy(*kept).agg(F.when(n > 0, F.sum("re") / n).otherwise(0.0).alias("re"), F.when(n > 0, F.sum("im") / n).otherwise(0.0).alias("im"))


def rss(df: DataFrame, kept: Sequence[str]) -> DataFrame:
    return df.groupBy(*kept).agg(F.sqrt(F.sum(energy())).alias("re")).withColumn("im", F.lit(0.0))


def variance(df: DataFrame, kept: Sequence[str]) -> DataFrame:
    """E|x - mean|^2 with divisor n - 1 (ours), and its root."""
    v = F.var_samp("re") + F.var_samp("im")
    return df.groupBy(*kept).agg(v.alias("var"), F.sqrt(v).alias("std"))


def projection(df: DataFrame, kept: Sequence[str], minimum: bool = False) -> DataFrame:
    """Largest (from zero up) or smallest real part."""
    v = F.min("re") if minimum else F.greatest(F.max("re"), F.lit(0.0))
    return df.groupBy(*kept).agg(v.alias("re")).withColumn("im", F.lit(0.0))


def normalize(df: DataFrame, kept: Sequence[str], l1: bool = False) -> DataFrame:
    """Divide by the l2 (or l1) norm over the axes that are not kept; zero stays zero.

    The norms are aggregated before the join, so a large group never sits in one window partition.
    """
    norm = F.sum(modulus()) if l1 else F.sqrt(F.sum(energy()))
    n = df.groupBy(*kept).agg(norm.alias("__n"))
    part = lambda c: F.when(F.col("__n") == 0, 0.0).otherwise(F.col(c) / F.col("__n"))
    return df.join(n, list(kept)).withColumns({"re": part("re"), "im": part("im")}).drop("__n")


def inner_product(a: DataFrame, b: DataFrame, axes: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """sum conj(a) * b."""
    b = b.withColumnsRenamed({"re": "br", "im": "bi"})
    j = a.join(b, list(axes))
    return j.groupBy(*kept).agg(F.sum(F.col("re") * F.col("br") + F.col("im") * F.col("bi")).alias("re"), F.sum(F.col("re") * F.col("bi") - F.col("im") * F.col("br")).alias("im"))


def histogram(df: DataFrame, bins: int, kept: Sequence[str] = ()) -> DataFrame:
    """Counts of real parts in [-0.5, 0.5); what lies outside is dropped; empty bins are counted as zero."""
    at = F.floor((F.col("re") + 0.5) * bins).cast("int")
    got = df.select(*kept, at.alias("bin")).where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy(*kept, "bin").agg(F.count("*").alias("n"))
    keys = df.select(*kept).distinct() if kept else df.sparkSession.range(1).select()
    every = keys.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(got, [*kept, "bin"], "left").select(*kept, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def weighted_regions(df: DataFrame, regions: DataFrame, axes: Sequence[str], region: str, kept: Sequence[str] = (), bessel: bool = False) -> DataFrame:
    """Statistics of regions that may overlap: rows (region, axes, re) of ``regions`` give the weights."""
    w = regions.where("re <> 0").select(region, *axes, F.col("re").alias("__w"))
    return region_statistics(df.join(w, list(axes)), [region, *kept], F.col("__w"), bessel)


def region_statistics(df: DataFrame, region: str | Sequence[str], weight: Column | None = None, bessel: bool = False) -> DataFrame:
    """count, sum, mean, energy (squared deviation), variance and std of a region; sums of weights count.

    ``bessel`` divides by count - 1.  One pass over n, sum x and sum |x|^2; the deviation follows from them.
    """
    w = F.lit(1.0) if weight is None else weight
    region = [region] if isinstance(region, str) else list(region)
    s = df.groupBy(*region).agg(F.sum(w).alias("count"), F.sum(w * F.col("re")).alias("s"), F.sum(w * F.col("im")).alias("si"), F.sum(w * energy()).alias("e"))
    dev = F.greatest(F.col("e") - (F.col("s") ** 2 + F.col("si") ** 2) / F.col("count"), F.lit(0.0))
    by = F.col("count") - (1 if bessel else 0)
    return s.select(*region, "count", F.col("s").alias("sum"), (F.col("s") / F.col("count")).alias("mean"), dev.alias("energy"), (dev / by).alias("variance"), F.sqrt(dev / by).alias("std"))


def pair(x: DataFrame, r: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Both images side by side, absent cells zero."""
    r = r.select(*axes, F.col("re").alias("rr"), F.col("im").alias("ri"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return x.select(*axes, "re", "im").join(r, list(axes), "full").select(*axes, *map(z, ("re", "im", "rr", "ri")))


def mse(x: DataFrame, r: DataFrame, axes: Sequence[str], kept: Sequence[str], size: int) -> DataFrame:
    d = (F.col("re") - F.col("rr")) ** 2 + (F.col("im") - F.col("ri")) ** 2
    return pair(x, r, axes).groupBy(*kept).agg((F.sum(d) / size).alias("mse"))


def nrmse(x: DataFrame, r: DataFrame, axes: Sequence[str], kept: Sequence[str], scaled: bool = False) -> DataFrame:
    """|x - r| / |r|; scaled: r is first multiplied by <r, x> / |r|^2.  One pass of sums, then closed form."""
    p = pair(x, r, axes).groupBy(*kept).agg(
        F.sum(F.col("rr") ** 2 + F.col("ri") ** 2).alias("r2"), F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("x2"),
        F.sum(F.col("rr") * F.col("re") + F.col("ri") * F.col("im")).alias("a"), F.sum(F.col("rr") * F.col("im") - F.col("ri") * F.col("re")).alias("b"),
    )
    if scaled:
        ab = F.col("a") ** 2 + F.col("b") ** 2
        v = F.sqrt(F.greatest(F.col("x2") - ab / F.col("r2"), F.lit(0.0)) / (ab / F.col("r2")))
    else:
        v = F.sqrt(F.greatest(F.col("x2") - 2 * F.col("a") + F.col("r2"), F.lit(0.0)) / F.col("r2"))
    return p.select(*kept, v.alias("nrmse"))


def psnr(x: DataFrame, r: DataFrame, axes: Sequence[str], image: Sequence[str], size: int) -> DataFrame:
    """Mean over images of 20 log10 max|r| - 10 log10 mean (|x| - |r|)^2."""
    mr = F.sqrt(F.col("rr") ** 2 + F.col("ri") ** 2)
    d = (F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) - mr) ** 2
    one = pair(x, r, axes).groupBy(*image).agg(F.max(mr).alias("m"), (F.sum(d) / size).alias("d"))
    return one.agg(F.avg(20 * F.log10("m") - 10 * F.log10("d")).alias("psnr"))


def data_scaling(df: DataFrame, kept: Sequence[str]) -> DataFrame:
    """90 % quantile of the magnitudes, or their maximum when it stands out; zero becomes one."""
    s = quantiles(df.select(*kept, modulus().alias("m")), kept, "m", {"q50": 0.5, "q90": 0.9})
    med, p90 = F.col("q50"), F.col("q90")
    v = F.when(F.col("top") - p90 >= 2 * (p90 - med), F.col("top")).otherwise(p90)
    return s.select(*kept, F.when(v == 0, 1.0).otherwise(v).alias("scale"))


def channel_gram(df: DataFrame, sample: str, channel: str, n: int, mean: bool = True, count: int | None = None) -> DataFrame:
    """mean (or sum) over samples of x_i conj(x_j) for i <= j; absent channels are zero.

    Channels of a sample are gathered once (a shuffle on the sample, to as many tasks as the rows need); a task multiplies
    whole batches of samples and sends one partial matrix, so only n^2 / 2 rows a task are shuffled for the result.
    ``count`` as for ``dealt``.
    """
    return gram_of_tiles(cells_to_tiles(dealt(df, sample, count=count), [sample], [channel], [n]), n, mean)


def gram_of_tiles(tiles: DataFrame, n: int, mean: bool = True) -> DataFrame:
    """As ``channel_gram`` for tiles of n channels each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((n, n), complex), 0
        for b in batches:
            x = (b.column("re").flatten().to_numpy(zero_copy_only=False) + 1j * b.column("im").flatten().to_numpy(zero_copy_only=False)).reshape(-1, n)
            total, rows = total + x.T @ np.conj(x), rows + len(x)
        i, j = np.triu_indices(n)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j].real), pa.array(total[i, j].imag), pa.array(np.full(len(i), rows))], ["i", "j", "re", "im", "rows"])

    small_batches(tiles.sparkSession, 16 * n)
    parts = tiles.select("re", "im").mapInArrow(run, "i int, j int, re double, im double, rows long")
    by = F.sum("rows") if mean else F.lit(1)
    return parts.groupBy("i", "j").agg((F.sum("re") / by).alias("re"), (F.sum("im") / by).alias("im"))


def density(df: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Samples in each cell and the compensating weight."""
    return df.groupBy(*cell).agg(F.count("*").alias("n")).withColumn("weight", 1.0 / F.col("n"))


def radial_weight(kx: Column, ky: Column) -> Column:
    return F.greatest(F.sqrt(kx * kx + ky * ky), F.lit(0.25))


def top_k(df: DataFrame, item: Sequence[str], joint: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The k largest magnitudes of an item; joint axes are kept or dropped together; ties by position.

    Ranks are taken over ranges of magnitudes, so an item may exceed a task.
    """
    pos = [a for a in order if a not in joint]
    m = df.groupBy(*item, *pos).agg(F.sum(energy()).alias("m"))
    best = ranks(m, item, [-F.round("m", 12), *pos], "n").where(F.col("n") < k)
    return df.join(best.select(*item, *pos), [*item, *pos], "left_semi")
