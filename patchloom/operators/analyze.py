"""Estimates and margins of error over implicates."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions.stats import partial_sums, pooled_error, t_quantile, weighted_estimates
from patchloom.operators.rank import interval, pieces
from patchloom.sources.scratch import stored

#: Groups of up to so many rows have the variance of their median from so many resamples, larger ones from the density.
SMALL, DRAWS = 1000, 200


def weighted_median(df: DataFrame, groups: Sequence[str], x: str = "x", w: str = "w") -> DataFrame:
    """(groups, est): the interpolated weighted median; equal values are one with their weights' sum.

    A value stands at the weight before it plus half its own; the median is read at half the total
    weight, linearly between neighbours. Only distinct values of a group are ordered, in ranges of values
    whose weights are added up before, so few groups don't mean few tasks.
    """
    knots = df.where(F.col(x).isNotNull()).groupBy(*groups, F.col(x).cast("double").alias("_x")).agg(F.sum(w).alias("_w"))
    knots = stored(knots, "values")
    n = pieces(knots.count())
    cuts = sorted(set(knots.approxQuantile("_x", [k / n for k in range(1, n)], 0.2 / n)))
    knots = knots.withColumn("_part", interval("_x", cuts))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = knots.groupBy(*groups, "_part").agg(F.sum("_w").alias("_s"))
    sums = sums.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"), (F.sum("_s").over(Window.partitionBy(*groups)) / 2).alias("_half"))
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    order = Window.partitionBy(*groups, "_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    knots = knots.join(sums, same).withColumn("_c", F.col("_start") + F.sum("_w").over(order) - F.col("_w") / 2)
    low, high = F.col("_c") <= F.col("_half"), F.col("_c") > F.col("_half")
    ends = knots.groupBy(*groups).agg(*(F.max(F.when(low, F.struct("_c", "_x"))).alias("_lo"), F.min(F.when(high, F.struct("_c", "_x"))).alias("_hi"), F.first("_half").alias("_half")))
    t = F.try_divide(F.col("_half") - F.col("_lo._c"), F.col("_hi._c") - F.col("_lo._c"))
    est = F.coalesce(F.col("_lo._x") + t * (F.col("_hi._x") - F.col("_lo._x")), F.col("_lo._x"), F.col("_hi._x"))
    return ends.select(*groups, est.alias("est"))


def median_variance(df: DataFrame, groups: Sequence[str], medians: DataFrame, x: str = "x", w: str = "w") -> DataFrame:
    """(groups, var): 1 / (4 n f(m)^2) with the weighted Gaussian kernel density at the median, in one aggregation.

    The bandwidth is 0.9 min(sd, IQR / 1.34) n^(-1/5); a group without spread has variance 0.
    """
    width = df.groupBy(*groups).agg(F.count(x).alias("_n"), F.stddev_samp(x).alias("_sd"), (F.percentile_approx(x, 0.75) - F.percentile_approx(x, 0.25)).alias("_iqr"))
    spread = F.when(F.col("_iqr") > 0, F.least(F.col("_sd"), F.col("_iqr") / 1.34)).otherwise(F.col("_sd"))
    width = width.withColumn("_h", 0.9 * spread * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    keyed = df.where(F.col(x).isNotNull())
    for other in (width, medians):
        keyed = keyed.join(other, list(groups)) if groups else keyed.crossJoin(other)
    z = F.try_divide(F.col(x) - F.col("est"), F.col("_h"))
    dense = keyed.groupBy(*groups).agg(F.first("_n").alias("_n"), F.try_divide(F.sum(F.col(w) * F.exp(-z * z / 2)), F.sum(w) * F.first("_h") * 2.5066282746310002).alias("_f"))
    return dense.select(*groups, F.coalesce(F.try_divide(F.lit(1.0), 4 * F.col("_n") * F.col("_f") * F.col("_f")), F.lit(0.0)).alias("var"))


@lru_cache(maxsize=2)
def draw_table(draws: int = DRAWS, most: int = SMALL) -> np.ndarray:
    """Keyed uniforms, a row for each resample and a column for each place in a group: 1.6 MB, the same for all groups."""
    digest = lambda b, i: int(hashlib.md5(f"boot|{b}|{i}".encode(), usedforsecurity=False).hexdigest()[:8], 16)
    return np.array([[digest(b, i) for i in range(1, most + 1)] for b in range(1, draws + 1)]) / 4294967296.0


def medians_of(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The interpolated weighted median of each row of x, all with the weights w; equal values are one with their weights' sum."""
    order = np.argsort(x, axis=1, kind="stable")
    x, w = np.take_along_axis(x, order, 1), w[order]
    upto = np.cumsum(w, axis=1)
    new = np.concatenate((np.ones((len(x), 1), bool), x[:, 1:] != x[:, :-1]), axis=1)
    start = np.maximum.accumulate(np.where(new, upto - w, -np.inf), axis=1)
    last = np.concatenate((new[:, 1:], np.ones((len(x), 1), bool)), axis=1)
    end = np.minimum.accumulate(np.where(last, upto, np.inf)[:, ::-1], axis=1)[:, ::-1]
    c, half = (start + end) / 2, upto[:, -1:] / 2
    below = (c <= half).sum(1)
    row, lo, hi = np.arange(len(x)), np.maximum(below - 1, 0), np.minimum(below, x.shape[1] - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(c[row, hi] > c[row, lo], (half[:, 0] - c[row, lo]) / (c[row, hi] - c[row, lo]), 0.0)
    return x[row, lo] + np.where(below == 0, 0.0, t) * (x[row, hi] - x[row, lo])


def bootstrap_variance(df: DataFrame, groups: Sequence[str], x: str = "x", w: str = "w") -> DataFrame:
    """(groups, var): the variance of the weighted median over DRAWS resamples of each group of up to SMALL rows; larger groups have no row.

    A resample draws values with replacement and leaves the weights in their places, the order of the rows by value and
    weight. Draws are keyed by resample and place, so they don't depend on partitions. Groups are counted before any rows are
    brought together, and a task holds one group's rows at a time.
    """
    data = df.where(F.col(x).isNotNull()).select(*groups, F.col(x).cast("double").alias("_x"), F.col(w).cast("double").alias("_w"))
    held = F.when(F.count("*") <= SMALL, F.lit(True))
    sizes = data.groupBy(*groups).agg(held.alias("_small")).where("_small").drop("_small")
    names = [f"_g{k}" for k in range(len(groups))]
    small = sizes.select(*[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)])
    same = F.lit(True)
    for g, n in zip(groups, names, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(n))
    rows = data.join(small, same).groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("_x", "_w"))).alias("_r"))
    draws = df.sparkSession.sparkContext.broadcast(draw_table(DRAWS, SMALL))

    def variance(values: pd.Series, weights: pd.Series) -> pd.Series:
        out = []
        for v, own in zip(values, weights, strict=True):
            pick = np.floor(draws.value[:, : len(v)] * len(v)).astype(int)
            out.append(float(np.var(medians_of(v[pick], np.asarray(own, float)), ddof=1)) if v.min() < v.max() else 0.0)
        return pd.Series(out)

    return rows.select(*groups, F.pandas_udf(variance, "double")(F.col("_r._x"), F.col("_r._w")).alias("var"))


def analyze(implicates: DataFrame, mean: Sequence[str] = (), sum: Sequence[str] = (), median: Sequence[str] = (), proportion: dict[str, Sequence] | None = None, count: dict[str, Sequence] | None = None, by: Sequence[str] = (), weight: str | None = None, rep_weights: Sequence[str] | None = None, static: DataFrame | None = None, id_col: str = "rid", m_col: str = "M", var_scale: float = 4.0, fun: Callable[[DataFrame], DataFrame] | None = None, detail: bool = False) -> DataFrame:  # noqa: A002
    """(by..., N, y, level, type, est, moe[, se, df]) pooled over implicates by Rubin's rules, at 90% confidence.

    Each implicate gives an estimate and its variance from one aggregation; pooling is a second, tiny
    one. proportion and count map a variable to its levels. The m-th of rep_weights serves implicate
    m. static holds columns that don't vary by implicate, joined on id_col. fun derives columns
    first. A group with a null value of a variable has no estimate for it; one implicate, no moe.
    """
    proportion, count = proportion or {}, count or {}
    if not (mean or sum or median or proportion or count):
        raise ValueError("no variable to analyze")
    if overlap := {*mean, *sum, *median, *proportion, *count} & set(by):
        raise ValueError(f"variables that are also groups: {sorted(overlap)}")
    if rep_weights and not weight:
        raise ValueError("rep_weights need a weight")
    data = implicates.join(static, id_col) if static is not None else implicates
    for c in [weight] * bool(weight) + list(rep_weights or []):
        if c not in data.columns:
            raise ValueError(f"no column {c}")
    data = fun(data) if fun else data
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    w2 = F.element_at(F.array(*[F.col(c).cast("double") for c in rep_weights]), F.col(m_col).cast("int")) if rep_weights else w
    item = lambda y, level, kind, x: F.struct(F.lit(y).alias("y"), F.lit(level).cast("string").alias("level"), F.lit(kind).alias("type"), x.cast("double").alias("x"))
    items = [item(y, None, kind, F.col(y)) for kind, names in (("mean", mean), ("sum", sum), ("median", median)) for y in names]
    items += [item(y, v, kind, F.col(y).eqNullSafe(F.lit(v))) for kind, names in (("proportion", proportion), ("count", count)) for y, levels in names.items() for v in levels]
    long = data.select(F.col(m_col).alias("_m"), *by, w.alias("_w"), w2.alias("_w2"), F.explode(F.array(*items)).alias("_i")).select("_m", *by, "_w", "_w2", "_i.*")
    keys = ["_m", *by, "y", "level", "type"]
    parts = long.groupBy(*keys).agg(*partial_sums("x", "_w", "_w2")).where("_nulls = 0")
    m1, m2, var = weighted_estimates()
    total = F.col("type").isin("sum", "count")
    each = parts.select(*keys, "_n", F.when(total, m1 * F.col("_sw")).otherwise(m1).alias("_e1"), F.when(total, m2 * F.col("_s2")).otherwise(m2).alias("_e2"), F.when(total, var * F.col("_sw") * F.col("_sw")).otherwise(var).alias("_v"))
    if median:
        rows = long.where("type = 'median'").withColumn("level", F.lit(""))
        first = weighted_median(rows, keys, "x", "_w")
        wide, drawn = median_variance(rows, keys, first, "x", "_w"), bootstrap_variance(rows, keys, "x", "_w").withColumnRenamed("var", "_drawn")
        spread = wide.join(drawn, keys, "left").select(*keys, F.coalesce("_drawn", "var").alias("var"))
        second = weighted_median(rows, keys, "x", "_w2").withColumnRenamed("est", "_second") if rep_weights else first.withColumnRenamed("est", "_second")
        medians = first.join(second, keys).join(spread, keys)
        counts = each.where("type = 'median'").withColumn("level", F.lit("")).select(*keys, "_n")
        medians = medians.join(counts, keys).select(*[F.lit(None).cast("string").alias("level") if k == "level" else F.col(k) for k in keys], "_n", F.col("est").alias("_e1"), F.col("_second").alias("_e2"), F.col("var").alias("_v"))
        each = each.where("type <> 'median'").unionByName(medians)
    pooled = each.groupBy(*by, "y", "level", "type").agg(F.count("*").alias("_k"), F.expr("cast(sum(_n) / count(*) as bigint)").alias("N"), F.avg("_e1").alias("est"), F.avg("_v").alias("_u"), F.coalesce(F.var_samp("_e1"), F.lit(0.0)).alias("_b1"), F.coalesce(F.var_samp("_e2"), F.lit(0.0)).alias("_b2"))
    extra = F.greatest(F.lit(0.0), F.col("_b2") - F.col("_b1")) * var_scale * (F.col("_k") - 1) / F.col("_k") if rep_weights else F.lit(0.0)
    pooled = pooled.withColumn("_b", F.col("_b1") + extra)
    se, df = pooled_error("_k", "_u", "_b")
    pooled = pooled.withColumns({"se": F.when(F.col("_k") > 1, se), "df": F.when(F.col("_k") > 1, df)})
    moe = F.when(F.col("_k") > 1, F.col("se") * t_quantile(0.95, F.col("df")))
    return pooled.withColumn("moe", moe).select(*by, "N", "y", "level", "type", "est", "moe", *(["se", "df"] if detail else []))
