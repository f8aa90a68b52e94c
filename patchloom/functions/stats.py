"""Weighted estimators as mergeable partial sums, pooling over implicates, and Student's t quantiles, all as columns."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def partial_sums(x: str, w: str, w2: str | None = None) -> list[Column]:
    """Aggregates from which weighted_estimates derives; they combine before the shuffle."""
    x_, w_ = F.col(x), F.col(w)
    sums = {"n": F.count("*"), "nulls": F.sum(x_.isNull().cast("int")), "sw": F.sum(w_), "sww": F.sum(w_ * w_), "swx": F.sum(w_ * x_), "swwx": F.sum(w_ * w_ * x_), "swwxx": F.sum(w_ * w_ * x_ * x_), "wide": F.max((~x_.isin(0.0, 1.0)).cast("int"))}
    second = F.col(w2) if w2 else w_
    return [c.alias(f"_{k}") for k, c in (sums | {"s2": F.sum(second), "s2x": F.sum(second * x_)}).items()]


def weighted_estimates() -> tuple[Column, Column, Column]:
    """(mean, mean by the second weight, variance of the mean) from partial sums.

    Values that are all 0 or 1 get the binomial variance, others the ratio estimator's; a single
    value of another kind has none.
    """
    n, sw = F.col("_n"), F.col("_sw")
    mean = F.try_divide(F.col("_swx"), sw)
    ratio = F.try_divide(n, (n - 1) * sw * sw) * (F.col("_swwxx") - 2 * mean * F.col("_swwx") + mean * mean * F.col("_sww"))
    variance = F.when(F.col("_wide") == 0, mean * (1 - mean) * F.try_divide(F.col("_sww"), sw * sw)).otherwise(F.when(ratio.isNotNull(), F.greatest(ratio, F.lit(0.0))))
    return mean, F.try_divide(F.col("_s2x"), F.col("_s2")), variance


def t_quantile(p: float, df: Column) -> Column:
    """Quantile of Student's t at p > 0.5 by Hill's expansion (Comm. ACM 13, 1970); a null or infinite df gives the normal one."""
    z = NormalDist().inv_cdf(p)
    tail = 2 * (1 - p)
    a = 1 / (df - 0.5)
    b = 48 / (a * a)
    c0 = ((20700 * a / b - 98) * a - 16) * a + 96.36
    d = ((94.5 / (b + c0) - 3) / b + 1) * F.sqrt(a * math.pi / 2) * df
    y0 = F.pow(d * tail, 2 / df)
    # near the centre: expansion about the normal quantile
    x = F.lit(-z)
    y1 = x * x
    c1 = c0 + F.when(df < 5, 0.3 * (df - 4.5) * (x + 0.6)).otherwise(0.0)
    c2 = (((0.05 * d * x - 5) * x - 7) * x - 2) * x + b + c1
    y2 = (((((0.4 * y1 + 6.3) * y1 + 36) * y1 + 94.5) / c2 - y1 - 3) / b + 1) * x
    y3 = a * y2 * y2
    near = F.expm1(y3)
    far = ((1 / (((df + 6) / (df * y0) - 0.089 * d - 0.822) * (df + 2) * 3) + 0.5 / (df + 4)) * y0 - 1) * (df + 1) / (df + 2) + 1 / y0
    general = F.sqrt(df * F.when(y0 > 0.05 + a, near).otherwise(far))
    exact1 = F.lit(math.tan(math.pi * (p - 0.5)))
    exact2 = F.lit((2 * p - 1) * math.sqrt(2 / (1 - (2 * p - 1) ** 2)))
    return F.when(df.isNull() | (df > 1e10), F.lit(z)).when(df == 1, exact1).when(df == 2, exact2).otherwise(general)


def pooled_error(m: str, ubar: str, b: str) -> tuple[Column, Column]:
    """(standard error, degrees of freedom) of Rubin's rules; the df is null where it is infinite."""
    k, within, between = F.col(m).cast("double"), F.col(ubar), F.col(b)
    spread = (1 + 1 / k) * between
    r = F.try_divide(spread, within)
    df = F.when(between == 0, F.lit(None)).when(within == 0, k - 1).otherwise((k - 1) * F.pow(1 + F.try_divide(F.lit(1.0), r), 2))
    return F.sqrt(within + spread), df


def normalize(x: Column, center: float | Column, scale: float | Column, eps: float = 0.001) -> Column:
    """Standardises and squashes so that the eps and 1 - eps normal quantiles become 0 and 1."""
    q = NormalDist().inv_cdf
    return ((x - center) / scale - q(eps)) / (2 * q(1 - eps))


def denormalize(z: Column, center: float | Column, scale: float | Column, eps: float = 0.001) -> Column:
    q = NormalDist().inv_cdf
    return (2 * z * q(1 - eps) + q(eps)) * scale + center


def signif(x: Column, digits: int) -> Column:
    """x rounded to so many significant digits; 0 and null stay."""
    magnitude = F.floor(F.log10(F.abs(x))).cast("int")
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x / F.pow(F.lit(10.0), magnitude - (digits - 1))) * F.pow(F.lit(10.0), magnitude - (digits - 1)))


def signif_within(x: Column, tolerance: float = 0.001, most: int = 15) -> Column:
    """x at the fewest significant digits whose relative error is at most tolerance."""
    return F.coalesce(*[F.when(F.abs(signif(x, d) - x) <= tolerance * F.abs(x), signif(x, d)) for d in range(1, most)], x)
