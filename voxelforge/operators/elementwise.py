"""Element-wise complex algebra on cells; every function returns the cells with new re and im."""

from __future__ import annotations

import math
import re as _re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _set(df: DataFrame, re: Column, im: Column) -> DataFrame:
    return df.withColumns({"re": re, "im": im})


def modulus(re: Column = None, im: Column = None) -> Column:
    re, im = (F.col("re"), F.col("im")) if re is None else (re, im)
    return F.sqrt(re * re + im * im)


def absolute(df: DataFrame) -> DataFrame:
    return _set(df, modulus(), F.lit(0.0))


def phase(df: DataFrame) -> DataFrame:
    return _set(df, F.atan2("im", "re"), F.lit(0.0))


def real(df: DataFrame) -> DataFrame:
    return _set(df, F.col("re"), F.lit(0.0))


def conj(df: DataFrame) -> DataFrame:
    return _set(df, F.col("re"), -F.col("im"))


def scale(df: DataFrame, a: float, b: float = 0.0) -> DataFrame:
    """Multiply by the complex number a + bi."""
    return _set(df, F.col("re") * a - F.col("im") * b, F.col("re") * b + F.col("im") * a)


def axpy(a: float, x: DataFrame, y: DataFrame, axes: Sequence[str]) -> DataFrame:
    """a * x + y; cells that one side lacks are zero there."""
    y = y.select(*axes, F.col("re").alias("__r"), F.col("im").alias("__i"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return x.select(*axes, "re", "im").join(y, list(axes), "full").select(*axes, (z("re") * a + z("__r")).alias("re"), (z("im") * a + z("__i")).alias("im"))


def power(df: DataFrame, p: float) -> DataFrame:
    """Principal complex power."""
    m, t = F.pow(modulus(), F.lit(float(p))), F.atan2("im", "re") * p
    return _set(df, m * F.cos(t), m * F.sin(t))


def exponential(df: DataFrame, imaginary: bool = False) -> DataFrame:
    """exp(x), or exp(i x)."""
    a, b = (-F.col("im"), F.col("re")) if imaginary else (F.col("re"), F.col("im"))
    return _set(df, F.exp(a) * F.cos(b), F.exp(a) * F.sin(b))


def logarithm(df: DataFrame) -> DataFrame:
    return _set(df, F.log(modulus()), F.atan2("im", "re"))


def invert(df: DataFrame) -> DataFrame:
    """1 / x, and zero where x is zero."""
    d = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return _set(df, F.when(d == 0, 0.0).otherwise(F.col("re") / d), F.when(d == 0, 0.0).otherwise(-F.col("im") / d))


def smooth_abs(df: DataFrame, eps: float) -> DataFrame:
    return _set(df, F.sqrt(F.col("re") ** 2 + F.col("im") ** 2 + eps), F.lit(0.0))


def unit_phase(df: DataFrame) -> DataFrame:
    """x / |x|, zero where x is zero."""
    m = modulus()
    return _set(df, F.when(m == 0, 0.0).otherwise(F.col("re") / m), F.when(m == 0, 0.0).otherwise(F.col("im") / m))


def copy_phase(magnitude: DataFrame, source: DataFrame, axes: Sequence[str]) -> DataFrame:
    """|magnitude| with the phase of source."""
    s = unit_phase(source).select(*axes, F.col("re").alias("__r"), F.col("im").alias("__i"))
    return magnitude.join(s, list(axes)).withColumn("__m", modulus()).withColumns({"re": F.col("__m") * F.col("__r"), "im": F.col("__m") * F.col("__i")}).drop("__m", "__r", "__i")


def component_diagonal(df: DataFrame, wre: float, wim: float) -> DataFrame:
    """Scale real and imaginary parts separately."""
    return _set(df, F.col("re") * wre, F.col("im") * wim)


def soft_threshold(df: DataFrame, lam: float, joint_over: Sequence[str] | None = None) -> DataFrame:
    """x * max(1 - lam / |x|, 0); with ``joint_over`` the norm is taken over all cells that agree on those axes."""
    e = F.col("re") ** 2 + F.col("im") ** 2
    m = F.sqrt(e)
    if joint_over is not None:  # aggregated first, so a large group never sits in one window partition
        norms = df.groupBy(*joint_over).agg(F.sqrt(F.sum(e)).alias("__m"))
        df, m = df.join(norms, list(joint_over)) if joint_over else df.crossJoin(F.broadcast(norms)), F.col("__m")  # of one row
    df = df.withColumn("__f", F.when(m == 0, 0.0).otherwise(F.greatest(1 - lam / m, F.lit(0.0))))
    return _set(df, F.col("re") * F.col("__f"), F.col("im") * F.col("__f")).drop("__f", "__m")


def hard_threshold(df: DataFrame, lam: float) -> DataFrame:
    """Keep cells with |x| > lam; the others become absent, which is zero."""
    return df.where(modulus() > lam)


def binary_threshold(df: DataFrame, lam: float) -> DataFrame:
    return _set(df, (modulus() > lam).cast("double"), F.lit(0.0))


def non_negative(df: DataFrame) -> DataFrame:
    """Clamp both parts at zero, separately."""
    return _set(df, F.greatest(F.col("re"), F.lit(0.0)), F.greatest(F.col("im"), F.lit(0.0)))


def prox_l2(df: DataFrame, lam: float, imaginary: bool = False) -> DataFrame:
    """Shrink by 1 / (1 + lam), or only the imaginary part."""
    f = 1.0 / (1.0 + lam)
    return component_diagonal(df, 1.0 if imaginary else f, f)


def prox_imaginary_l1(df: DataFrame, lam: float) -> DataFrame:
    """Soft-threshold only the imaginary part."""
    return _set(df, F.col("re"), F.signum("im") * F.greatest(F.abs("im") - lam, F.lit(0.0)))


def window(df: DataFrame, sizes: dict[str, int], hann: bool = False) -> DataFrame:
    """Hamming (or Hann) window along axes; an axis of size one is left alone."""
    a, f = 0.5 if hann else 0.54, F.lit(1.0)
    for axis, n in sizes.items():
        if n > 1:
            f = f * (a - (1 - a) * F.cos(F.col(axis) * (2 * math.pi / (n - 1))))
    return _set(df, F.col("re") * f, F.col("im") * f)


def rotate(df: DataFrame, angle: Column) -> DataFrame:
    """Multiply by exp(i angle)."""
    return _set(df, F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle), F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle))


def fft_modulation(df: DataFrame, sizes: dict[str, int], inverse: bool = False) -> DataFrame:
    """Phase that centres an uncentred transform; for odd sizes it is a phase, not a sign."""
    t = F.lit(0.0)
    for axis, n in sizes.items():
        c = n // 2
        t = t + (F.col(axis) - c / 2) * (2 * math.pi * c / n)
    return rotate(df, -t if inverse else t)


def fov_shift_along(df: DataFrame, trajectory: DataFrame, on: Sequence[str], shift: dict[str, float]) -> DataFrame:
    """exp(2 pi i k shift) of samples whose coordinates stand in a trajectory table; shift maps a coordinate to fields of view."""
    t = sum((F.col(f"__{c}") * (2 * math.pi * v) for c, v in shift.items()), F.lit(0.0))
    return rotate(df.join(trajectory.select(*on, *(F.col(c).alias(f"__{c}") for c in shift)), list(on)), t).drop(*(f"__{c}" for c in shift))


def fov_shift(df: DataFrame, shift: dict[str, tuple[int, float]]) -> DataFrame:
    """exp(2 pi i k shift) with k = p - n // 2; shift maps an axis to (size, shift in fields of view)."""
    t = F.lit(0.0)
    for axis, (n, s) in shift.items():
        t = t + (F.col(axis) - n // 2) * (2 * math.pi * s)
    return rotate(df, t)


def calc(df: DataFrame, re: str, im: str = "0.0") -> DataFrame:
    """SQL expressions over the cell's own columns; other names, subqueries and statements are refused."""
    known = set(df.columns) | {"sin", "cos", "exp", "ln", "sqrt", "abs", "pow", "atan2", "hypot", "least", "greatest", "when", "case", "then", "else", "end", "and", "or", "not"}
    for text in (re, im):
        if _re.search(r"[^\w\s.+\-*/%(),<>=]", text) or not {w.lower() for w in _re.findall(r"[A-Za-z_]\w*", text)} <= {k.lower() for k in known}:
            raise ValueError(f"not allowed in an expression: {text!r}")
    return _set(df, F.expr(re).cast("double"), F.expr(im).cast("double"))
