"""Operators along one ordered axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .ranks import ranks, tiles


def _ordered(rest: Sequence[str], axis: str):
    return Window.partitionBy(*rest).orderBy(axis)


def length_of(rest: Sequence[str]) -> Column:
    """Cells of a dense series, from the series itself."""
    return F.count("*").over(Window.partitionBy(*rest))


#: Positions of a series that one task handles at once; longer series are cut into stretches.
STRETCH = 100_000


def stretches(df: DataFrame, rest: Sequence[str], axis: str, length: int) -> tuple[DataFrame, WindowSpec, Column]:
    """(cells dealt to stretches, their order, whether a cell is a stretch's own).

    A stretch also gets the length - 1 cells after its end, so that windows that begin in it are whole.
    The axis must be dense, as it is in a series.
    """
    own = F.floor(F.col(axis) / STRETCH)
    reach = -(-(length - 1) // STRETCH)
    targets = F.filter(F.sequence(own - reach, own), lambda t: (t >= 0) & (F.col(axis) < (t + 1) * STRETCH + length - 1))
    dealt = df.withColumn("__s", F.explode(targets))
    return dealt, Window.partitionBy(*rest, "__s").orderBy(axis), F.col("__s") == own


def moving_average(df: DataFrame, rest: Sequence[str], axis: str, length: int) -> DataFrame:
    """Means of whole windows: n cells become n - length + 1; shorter series vanish."""
    df, order, own = stretches(df, rest, axis, length)
    w = order.rowsBetween(0, length - 1)
    out = df.withColumns({"__n": F.count("*").over(w), "__r": F.avg("re").over(w), "__i": F.avg("im").over(w)})
    return out.where(own & (F.col("__n") == length)).withColumns({"re": F.col("__r"), "im": F.col("__i")}).drop("__n", "__r", "__i", "__s")


def median_filter(df: DataFrame, rest: Sequence[str], axis: str, length: int) -> DataFrame:
    """Median by magnitude of whole windows; the mean of the middle two for even lengths; ties by position."""
    df, order, own = stretches(df, rest, axis, length)
    w = order.rowsBetween(0, length - 1)
    got = F.sort_array(F.collect_list(F.struct(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("m"), F.col(axis).alias("p"), "re", "im")).over(w))
    df = df.withColumn("__w", got).where(own & (F.size("__w") == length))
    mid = [(length - 1) // 2, length // 2]
    take = lambda c: sum((F.get("__w", F.lit(m))[c] for m in mid), F.lit(0.0)) / 2
    return df.withColumns({"re": take("re"), "im": take("im")}).drop("__w", "__s")


def geometric_median(df: DataFrame, rest: Sequence[str], axis: str, length: int, iterations: int = 10) -> DataFrame:
    """Weiszfeld iterations from zero in the complex plane over whole windows."""
    df, order, own = stretches(df, rest, axis, length)
    w = order.rowsBetween(0, length - 1)
    df = df.withColumn("__w", F.collect_list(F.struct("re", "im")).over(w)).where(own & (F.size("__w") == length)).drop("__s")

    def step(m: Column, _: Column) -> Column:
        weight = lambda v: 1.0 / F.greatest(F.sqrt((v["re"] - m["re"]) ** 2 + (v["im"] - m["im"]) ** 2), F.lit(1e-12))
        zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
        s = F.aggregate("__w", zero, lambda a, v: F.struct((a["w"] + weight(v)).alias("w"), (a["re"] + weight(v) * v["re"]).alias("re"), (a["im"] + weight(v) * v["im"]).alias("im")))
        return F.struct((s["re"] / s["w"]).alias("re"), (s["im"] / s["w"]).alias("im"))

    start = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    df = df.withColumn("__m", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step))
    return df.withColumns({"re": F.col("__m.re"), "im": F.col("__m.im")}).drop("__m", "__w")


def unwrap(df: DataFrame, rest: Sequence[str], axis: str, bound: float) -> DataFrame:
    """Steps beyond the bound are corrected by whole bounds, cumulatively; real parts only.

    Corrections add up within a stretch; what earlier stretches add is summed over their totals.
    """
    dealt, order, own = stretches(df, rest, axis, 2)
    d = F.lead("re").over(order) - F.col("re")  # of the next cell, which a stretch also has
    fix = F.when(F.abs(d) > bound, -F.signum(d) * F.ceil(F.abs(d) / bound) * bound).otherwise(0.0)
    steps = dealt.withColumn("__f", F.coalesce(fix, F.lit(0.0))).where(own)
    inside = steps.withColumn("__c", F.coalesce(F.sum("__f").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    totals = steps.groupBy(*rest, "__s").agg(F.sum("__f").alias("__t"))
    before = F.coalesce(F.sum("__t").over(Window.partitionBy(*rest).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = totals.withColumn("__b", before).drop("__t")
    return inside.join(sums, [*rest, "__s"]).withColumns({"re": F.col("re") + F.col("__c") + F.col("__b"), "im": F.lit(0.0)}).drop("__f", "__c", "__b", "__s")


def hankel(df: DataFrame, axis: str, n: Column | int, window: int) -> DataFrame:
    """n samples become positions x window offsets."""
    n = F.lit(n) if isinstance(n, int) else n
    df = df.withColumn("__n", n).withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(window - 1)))).withColumn("p", F.col(axis) - F.col("w"))
    return df.where((F.col("p") >= 0) & (F.col("p") <= F.col("__n") - window)).drop("__n", axis)


def hankel_adjoint(df: DataFrame, rest: Sequence[str], axis: str) -> DataFrame:
    return df.groupBy(*rest, (F.col("p") + F.col("w")).alias(axis)).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def casorati(df: DataFrame, axes: Sequence[tuple[str, int, int]]) -> DataFrame:
    """All overlapping blocks: (axis, size, kernel) -> block element and block number, both row-major."""
    element, number = F.lit(0), F.lit(0)
    for a, n, k in axes:
        df = df.withColumn(f"__{a}", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        start = F.col(a) - F.col(f"__{a}")
        df = df.where((start >= 0) & (start <= n - k))
        element, number = element * k + F.col(f"__{a}"), number * (n - k + 1) + start
    return df.withColumns({"element": element, "block": number}).drop(*(f"__{a}" for a, _, _ in axes), *(a for a, _, _ in axes))


def gradient(df: DataFrame, rest: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Circular forward differences, components in the order of the axes on a new axis d."""
    out = None
    for i, a in enumerate(axes):
        others = [*rest, *(b for b in axes if b != a)]
        w = Window.partitionBy(*others).orderBy(a)
        nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0)))  # noqa: E731,B023
        one = df.withColumns({"__r": nxt("re") - F.col("re"), "__i": nxt("im") - F.col("im"), "d": F.lit(i)}).select("d", *rest, *axes, F.col("__r").alias("re"), F.col("__i").alias("im"))
        out = one if out is None else out.unionByName(one)
    return out


def convolve(df: DataFrame, kernel: Sequence[float], rest: Sequence[str], axis: str, n: Column | int, mode: str = "wrap") -> DataFrame:
    """out[i] = sum_j k[j] x[i - j + (len - 1) // 2]; wrap, or same, valid, full with zeros outside."""
    k, n = len(kernel), F.lit(n) if isinstance(n, int) else n
    centre = {"wrap": (k - 1) // 2, "same": (k - 1) // 2, "valid": k - 1, "full": 0}[mode]
    taps = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(float(v)).alias("v")) for j, v in enumerate(kernel)))
    df = df.withColumn("__n", n).withColumn("__t", F.explode(taps)).withColumn("__o", F.col(axis) + F.col("__t.j") - centre)
    if mode == "wrap":
        df = df.withColumn("__o", F.pmod("__o", "__n"))
    else:
        size = {"same": F.col("__n"), "valid": F.col("__n") - k + 1, "full": F.col("__n") + k - 1}[mode]
        df = df.where((F.col("__o") >= 0) & (F.col("__o") < size))
    return df.groupBy(*rest, F.col("__o").cast("int").alias(axis)).agg(F.sum(F.col("re") * F.col("__t.v")).alias("re"), F.sum(F.col("im") * F.col("__t.v")).alias("im"))


def phase_bins(df: DataFrame, a: str, b: str, bins: int, offset: float = 0.0) -> DataFrame:
    """Equal-angle bins of the phase of a quadrature pair (ours: floor(bins * phase / 2 pi) after the offset)."""
    t = F.pmod(F.atan2(b, a) + offset, F.lit(2 * 3.141592653589793))
    return df.withColumn("bin", F.least(F.floor(t * bins / (2 * 3.141592653589793)), F.lit(bins - 1)).cast("int"))


def smooth_phase_bins(df: DataFrame, rest: Sequence[str], axis: str, a: str, b: str, length: int, bins: int) -> DataFrame:
    """Phase bins of a quadrature pair from which a moving average of ``length`` was taken (as far as the ends allow)."""
    before, after = length // 2, length - 1 - length // 2
    own = F.floor(F.col(axis) / STRETCH)
    near = F.sequence(own - -(-after // STRETCH) - 1, own + -(-before // STRETCH) + 1)
    targets = F.filter(near, lambda t: (t >= 0) & (F.col(axis) >= t * STRETCH - before) & (F.col(axis) < (t + 1) * STRETCH + after))
    dealt = df.withColumn("__s", F.explode(targets))
    w = Window.partitionBy(*rest, "__s").orderBy(axis).rowsBetween(-before, after)
    flat = dealt.withColumns({f"__{c}": F.col(c) - F.avg(c).over(w) for c in (a, b)}).where(F.col("__s") == own)
    return phase_bins(flat, f"__{a}", f"__{b}", bins).drop(f"__{a}", f"__{b}", "__s")


def amplitude_bins(df: DataFrame, rest: Sequence[str], value: str, order: str, bins: int) -> DataFrame:
    """Bins with equal numbers of samples, from small to large values; ties by ``order``."""
    ranked = ranks(df, rest, [value, order], "__rank", "__total")
    return ranked.withColumn("bin", tiles(F.col("__rank"), F.col("__total"), bins)).drop("__rank", "__total")


def two_way_bins(df: DataFrame, first: tuple[str, int], second: tuple[str, int]) -> DataFrame:
    """One number for two sets of bins, e.g. respiratory times cardiac; (column, bins)."""
    return df.withColumn("bin", (F.col(first[0]) * second[1] + F.col(second[0])).cast("int"))


def bin_by_label(df: DataFrame, label: str, rest: Sequence[str], time: Sequence[str]) -> DataFrame:
    """Regroup samples by label: the label is a new axis, the place within it another."""
    return ranks(df, [*rest, label], list(time), "slot").withColumn("slot", F.col("slot").cast("int"))
