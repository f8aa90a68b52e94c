"""Observed against simulated estimates over subsets, and what their differences amount to."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions.stats import partial_sums, pooled_error, t_quantile, weighted_estimates
from patchloom.operators.smooth import met
from patchloom.sources.scratch import stored


def subsets(subset_vars: Sequence[str]) -> list[list[str]]:
    """Every variable alone and every pair."""
    return [[v] for v in subset_vars] + [list(p) for p in combinations(subset_vars, 2)]


def bin_edges(df: DataFrame, column: str, bins: int = 5) -> list[float]:
    """Inner edges of bins found by one-dimensional k-means on the distinct values' frequencies, started at even places."""
    freq = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).count()
    places = sorted(set(df.where(F.col(column).isNotNull()).approxQuantile(column, [(k + 0.5) / bins for k in range(bins)], 0.001)))
    centers = [float(p) for p in places]
    for _ in range(20):
        edges = [(a + b) / 2 for a, b in zip(centers, centers[1:])]
        own = freq.groupBy(_bin(F.col("v"), edges).alias("k")).agg((F.sum(F.col("v") * F.col("count")) / F.sum("count")).alias("c"))
        new = sorted(r.c for r in own.collect())  # one row a bin
        if new == centers:
            break
        centers = new
    return [(a + b) / 2 for a, b in zip(centers, centers[1:])]


def _bin(c: Column, edges: Sequence[float]) -> Column:
    out = F.lit(1)
    for e in edges:
        out = out + (c > e).cast("int")
    return F.when(c.isNotNull(), out)


def binned(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    return df.withColumn(column, _bin(F.col(column), edges))


def subset_rows(df: DataFrame, subset_vars: Sequence[str], aggregates: Sequence[Column], extra: Sequence[str] = ()) -> DataFrame:
    """Aggregates over every subset of singles and pairs in one pass; `subset` names the grouping, unused variables are null.

    extra keys belong to every grouping. grouping_id tells a null value from an unused variable.
    """
    sets = subsets(subset_vars)
    keyed = df.groupingSets([[*(F.col(c) for c in extra), *(F.col(c) for c in s)] for s in sets], *extra, *subset_vars).agg(F.grouping_id().alias("_gid"), *aggregates)
    name = F.lit(None).cast("string")
    for s in sets:
        gid = sum(1 << (len(subset_vars) - 1 - k) for k, v in enumerate(subset_vars) if v not in s)
        name = F.when(F.col("_gid") == gid, F.lit("*".join(s))).otherwise(name)
    return keyed.withColumn("subset", name).drop("_gid")


def subset_shares(df: DataFrame, subset_vars: Sequence[str], total: int, min_size: int = 30) -> DataFrame:
    """(subset, values..., share) of the subsets with at least min_size rows."""
    return subset_rows(df, subset_vars, [F.count("*").alias("_n")]).where(F.col("_n") >= min_size).select("subset", *subset_vars, (F.col("_n") / F.lit(total)).alias("share"))


def _long(df: DataFrame, targets: dict[str, Sequence | None], keep: Sequence[str], weight: str | None) -> DataFrame:
    item = lambda y, level, x: F.struct(F.lit(y).alias("y"), F.lit(level).cast("string").alias("level"), x.cast("double").alias("x"))
    items = []
    for y, levels in targets.items():
        items += [item(y, None, F.col(y))] if levels is None else [item(y, v, F.col(y).eqNullSafe(F.lit(v))) for v in levels]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.select(*keep, w.alias("_w"), F.explode(F.array(*items)).alias("_i")).select(*keep, "_w", "_i.*")


def observed(df: DataFrame, targets: dict[str, Sequence | None], subset_vars: Sequence[str], weight: str | None = None, min_size: int = 30) -> DataFrame:
    """(subset, values..., y, level, n, est_obs, moe_obs). targets map a variable to its levels, or to None for a numeric one."""
    parts = subset_rows(_long(df, targets, subset_vars, weight), subset_vars, partial_sums("x", "_w"), ["y", "level"]).where((F.col("_n") >= min_size) & (F.col("_nulls") == 0))
    mean, _, var = weighted_estimates()
    df_ = (F.col("_n") - 1).cast("double")
    return parts.select("subset", *subset_vars, "y", "level", F.col("_n").alias("n"), mean.alias("est_obs"), (F.sqrt(var) * t_quantile(0.95, df_)).alias("moe_obs"))


def simulated(implicates: DataFrame, targets: dict[str, Sequence | None], subset_vars: Sequence[str], weight: str | None = None, min_size: int = 30, m_col: str = "M") -> DataFrame:
    """(subset, values..., y, level, n, est_sim, moe_sim) pooled over implicates; an infinite df is the subset's size less one."""
    long = _long(implicates, targets, [m_col, *subset_vars], weight)
    parts = subset_rows(long, subset_vars, partial_sums("x", "_w"), [m_col, "y", "level"]).where((F.col("_n") >= min_size) & (F.col("_nulls") == 0))
    mean, _, var = weighted_estimates()
    each = parts.select("subset", *subset_vars, "y", "level", "_n", mean.alias("_e"), var.alias("_v"))
    pooled = each.groupBy("subset", *subset_vars, "y", "level").agg(F.expr("cast(max(_n) as bigint)").alias("n"), F.count("*").alias("_k"), F.avg("_e").alias("est_sim"), F.avg("_v").alias("_u"), F.coalesce(F.var_samp("_e"), F.lit(0.0)).alias("_b"))
    se, df = pooled_error("_k", "_u", "_b")
    return pooled.withColumns({"_se": se, "_df": F.coalesce(df, (F.col("n") - 1).cast("double"))}).select("subset", *subset_vars, "y", "level", "n", "est_sim", (F.col("_se") * t_quantile(0.95, F.col("_df"))).alias("moe_sim"))


def compared(obs: DataFrame, sim: DataFrame, baseline: DataFrame, subset_vars: Sequence[str]) -> DataFrame:
    """Joins both sides and adds err (relative error), moe_ratio and vad (value added over the overall mean in baseline(y, level, est_mean))."""
    keys = ["subset", *subset_vars, "y", "level"]
    condition = None
    for k in keys:
        same = obs[k].eqNullSafe(sim[k])
        condition = same if condition is None else condition & same
    both = obs.join(sim.withColumnRenamed("n", "_n_sim"), condition).select(*[obs[k] for k in keys], "n", "est_obs", "moe_obs", "est_sim", "moe_sim")
    both = both.join(baseline, both["y"].eqNullSafe(baseline["y"]) & both["level"].eqNullSafe(baseline["level"])).select(*[both[c] for c in both.columns], "est_mean")
    difference = F.abs(F.col("est_sim") - F.col("est_obs"))
    err = F.when(difference == 0, F.lit(0.0)).otherwise(F.try_divide(difference, F.abs("est_obs")))
    ratio = F.when((F.col("moe_sim") == F.col("moe_obs")) & (F.col("est_sim") == F.col("est_obs")), F.lit(1.0)).otherwise(F.try_divide(F.try_divide(F.col("moe_sim"), F.col("est_sim")), F.try_divide(F.col("moe_obs"), F.col("est_obs"))))
    vad = F.coalesce(F.greatest(F.lit(0.0), 1 - F.try_divide(difference, F.abs(F.col("est_mean") - F.col("est_obs")))), F.lit(0.0))
    return both.withColumns({"err": err, "moe_ratio": ratio, "vad": vad})


def smooth_curve(df: DataFrame, groups: str | Sequence[str], x: str, y: str, points: int = 50) -> DataFrame:
    """(groups, x, y): the median of y in bins of equal counts of x, smoothed over neighbouring bins; a curve of at most `points` points a group.

    Rows are estimates of subsets, not data, so a group's rows are few. Ties in x are ordered by y; rows with a null y play no part.
    """
    keys = [groups] if isinstance(groups, str) else list(groups)
    rank = Window.partitionBy(*keys).orderBy(x, y)
    bins = df.where(F.col(y).isNotNull()).withColumn("_k", F.ntile(points).over(rank)).groupBy(*keys, "_k").agg(F.avg(x).alias(x), F.percentile(y, 0.5).alias("_m"))
    near = Window.partitionBy(*keys).orderBy("_k").rowsBetween(-2, 2)
    return bins.select(*keys, x, F.avg("_m").over(near).alias(y))


#: The metrics of a comparison by the names of their columns, and how a chart shows them: title, least and greatest value, line of reference.
METRICS = {"err": ("Median absolute percent error", 0.0, None, None), "vad": ("Median value-added", 0.0, 1.0, 1.0), "moe_ratio": ("Median ratio of simulated-to-observed uncertainty", 0.0, None, 1.0)}


@dataclass
class Report:
    """smooth: (y, level, metric, share, value); means: (y, level, err, vad, moe_ratio), averages of the smoothed values; charts: one JSON text each."""

    smooth: DataFrame
    means: DataFrame
    charts: DataFrame


def report(compared_: DataFrame, total: int, points: int = 50) -> Report:
    """Curves of each variable's metrics over the share that subsets have of all rows, held to what the variable's estimates reach.

    A smoothed value below the least or above the greatest of its variable and metric is that one instead. Charts are one of all variables
    for each metric, and one for each variable and metric with its estimates as points within ten MADs of their median.
    """
    keys = ["y", "level", "metric"]
    item = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS]))
    long = stored(compared_.select("y", "level", (F.col("n") / F.lit(total)).alias("share"), item.alias("_i")).select("y", "level", "share", "_i.*").where("value is not null"), "metrics")
    curves = smooth_curve(long, keys, "share", "value", points)
    bounds = long.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    smooth = stored(met(curves, bounds, keys).select(*keys, "share", F.least(F.greatest("value", F.col("_lo")), F.col("_hi")).alias("value")), "smooth")
    means = smooth.groupBy("y", "level").pivot("metric", list(METRICS)).agg(F.avg("value"))
    middle = long.groupBy(*keys).agg(F.percentile("value", 0.5).alias("_mid"))
    off = met(long, middle, keys)
    off = met(off, off.groupBy(*keys).agg((F.percentile(F.abs(F.col("value") - F.col("_mid")), 0.5) * 1.4826).alias("_mad")), keys)
    dots = off.where(F.abs(F.col("value") - F.col("_mid")) <= 10 * F.col("_mad")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("share", "value"))).alias("points"))
    lines = smooth.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("share", "value"))).alias("line"))
    label = F.concat_ws(" = ", "y", "level")
    facts = F.create_map(*[F.lit(v) for m, (title, lo, hi, ref) in METRICS.items() for v in (m, json.dumps({"title": title, "least": lo, "greatest": hi, "reference": ref}))])
    axis = F.lit(json.dumps({"field": "share", "scale": "sqrt", "title": "Subset size (share of total population)"}))
    everyone = lines.groupBy("metric").agg(F.array_sort(F.collect_list(F.struct(label.alias("series"), "line"))).alias("series")).select(F.concat(F.lit("allvars_"), "metric").alias("name"), "metric", F.to_json(F.struct("series")).alias("data"))
    each = met(lines, dots, keys, "left").select(F.concat_ws("_", "y", "level", "metric").alias("name"), "metric", F.to_json(F.struct("line", "points")).alias("data"))
    charts = everyone.unionByName(each).select("name", F.concat(F.lit('{"name":'), F.to_json(F.struct("name")).substr(F.lit(9), F.length(F.to_json(F.struct("name"))) - 9), F.lit(',"x":'), axis, F.lit(',"y":'), facts[F.col("metric")], F.lit(',"data":'), "data", F.lit("}")).alias("spec"))
    return Report(smooth, means, charts)


def write_charts(charts: DataFrame, path: str) -> str:
    """Writes each chart's description to path/name=.../, a JSON text a folder; what was there goes."""
    charts.write.mode("overwrite").partitionBy("name").text(path)
    return path
