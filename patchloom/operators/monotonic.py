"""Making y rise or fall with x in each group, for pairs such as consumption and expenditure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.operators.smooth import in_order, met, super_smoothed
from patchloom.sources.scratch import stored


def expend_fixups(df: DataFrame, x: str, y: str, groups: Sequence[str] = ()) -> DataFrame:
    """y is 0 where x is 0, and the group's least positive y where x is positive and y is 0; negative values raise."""
    least = df.groupBy(*groups).agg(F.min(F.when(F.col(y) > 0, F.col(y))).alias("_least"))
    bad = F.when((F.col(x) < 0) | (F.col(y) < 0), F.raise_error(F.lit("x and y must not be negative")).cast("double"))
    fixed = F.when(bad.isNotNull(), bad).when(F.col(x) == 0, F.lit(0.0)).when(F.col(y) == 0, F.col("_least")).otherwise(F.col(y))
    return met(df, least, list(groups)).withColumn(y, fixed).drop("_least")


def rearranged(df: DataFrame, x: str, y: str, groups: Sequence[str], id_col: str, name: str = "y_mono") -> DataFrame:
    """Pairs the sorted y with the sorted x of each group, falling where they are negatively correlated: ranks meet in an equi-join."""
    sign = df.groupBy(*groups).agg(F.coalesce(F.corr(x, y), F.lit(1.0)).alias("_r"))
    rank_x = F.row_number().over(Window.partitionBy(*groups).orderBy(x, id_col))
    xs = df.select(id_col, *groups, rank_x.alias("_k"))
    ys = df.select(*groups, F.col(y).alias(name), id_col).join(sign, list(groups))
    rank_y = F.row_number().over(Window.partitionBy(*groups).orderBy(F.when(F.col("_r") >= 0, F.col(name)).otherwise(-F.col(name)), id_col))
    return df.join(xs.join(ys.select(*groups, name, rank_y.alias("_k")), [*groups, "_k"]).select(id_col, name), id_col)


def interpolated(queries: DataFrame, knots: DataFrame, groups: Sequence[str], x: str, y: str, id_col: str, name: str = "y_hat") -> DataFrame:
    """Linear interpolation of the knots (x, y) of each group at the queries' x, held constant beyond the ends.

    Knots of equal x are averaged. Both tables meet in order of x: the knot before and the knot after each query.
    """
    flat = knots.groupBy(*groups, F.col(x).cast("double").alias("_x")).agg(F.avg(y).alias("_y"))
    both = flat.select(*groups, "_x", F.struct("_x", "_y").alias("_knot"), F.lit(None).cast(queries.schema[id_col].dataType).alias(id_col)).unionByName(
        queries.select(*groups, F.col(x).cast("double").alias("_x"), F.lit(None).cast("struct<_x:double,_y:double>").alias("_knot"), id_col)
    )
    order = Window.partitionBy(*groups).orderBy("_x")
    lo = F.last("_knot", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    hi = F.first("_knot", ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    met = both.withColumns({"_lo": lo, "_hi": hi}).where(F.col(id_col).isNotNull())
    t = F.try_divide(F.col("_x") - F.col("_lo._x"), F.col("_hi._x") - F.col("_lo._x"))
    value = F.coalesce(F.col("_lo._y") + t * (F.col("_hi._y") - F.col("_lo._y")), F.col("_lo._y"), F.col("_hi._y"))
    return met.select(id_col, *groups, F.col("_x").alias(x), value.alias(name))


def monotonic(df: DataFrame, x: str, y: str, id_col: str, groups: Sequence[str] = (), weight: str | None = None, preserve: bool = True, expend: bool = True, name: str = "y_mono") -> DataFrame:
    """Adds name: y super-smoothed over x, sorted along x in its own direction and, if preserve, scaled to the group's weighted mean of y.

    expend also sets y to 0 where x is 0 and never below the least positive y elsewhere. Equal x get equal values. All steps
    are aggregations, ordered ranges and joins over the distinct x of a group, so one group is as good as many.
    """
    keys = list(groups)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = stored(df.select(id_col, *keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), w.alias("_w")), "base")
    fixed = expend_fixups(base, "_x", "_y", keys) if expend else base
    curve = stored(super_smoothed(fixed, "_x", "_y", keys, "_w"), "curve")
    facts = base.groupBy(*keys).agg(F.min(F.when(F.col("_y") > 0, F.col("_y"))).alias("_least"), F.sum(F.col("_y") * F.col("_w")).alias("_total"))
    facts = met(facts, curve.groupBy(*keys).agg(F.coalesce(F.corr("_x", "smooth"), F.lit(1.0)).alias("_r0")), keys)
    facts = stored(facts, "facts")
    # the smoothed values in order, met by their places with the x in order
    values = met(curve, facts, keys).select(*keys, F.when(F.col("_r0") >= 0, F.col("smooth")).otherwise(-F.col("smooth")).alias("_v"))
    ties = stored(values.groupBy(*keys, "_v").agg(F.count("*").cast("double").alias("_k")), "values")
    upto = in_order(ties, keys, "_v", ["_k"]).select(*keys, "_v", F.explode(F.sequence((F.col("_c__k") - F.col("_k") + 1).cast("long"), F.col("_c__k").cast("long"))).alias("_place"))
    xs = in_order(curve.select(*keys, "_x", "w"), keys, "_x").select(*keys, "_x", "w", F.col("_r").cast("long").alias("_place"))
    paired = met(met(xs, upto, [*keys, "_place"]), facts, keys)
    low = lambda c: F.when(F.col("_x") == 0, F.lit(0.0)).otherwise(F.greatest(c, F.col("_least"))) if expend else c
    paired = paired.withColumn("_m", low(F.when(F.col("_r0") >= 0, F.col("_v")).otherwise(-F.col("_v"))))
    if preserve:
        paired = stored(paired, "paired")
        scale = paired.groupBy(*keys).agg(F.coalesce(F.try_divide(F.first("_total"), F.sum(F.col("_m") * F.col("w"))), F.lit(1.0)).alias("_scale"))
        paired = met(paired, scale, keys).withColumn("_m", low(F.col("_m") * F.col("_scale")))
    flat = paired.select(*keys, F.col("_x").alias("_at"), F.col("_m").alias(name))
    held = df.withColumns({"_at": F.col(x).cast("double"), y: F.col(y).cast("double")})
    return met(held, flat, [*keys, "_at"], "left").drop("_at")


def isotonic(df: DataFrame, x: str, y: str, weight: str | None = None, rising: bool = True, name: str = "y_iso") -> DataFrame:
    """Adds the weighted isotonic regression of y on x (Spark ML), for the fully constrained fit."""
    from pyspark.ml.regression import IsotonicRegression

    options = {"weightCol": weight} if weight else {}
    data = df.withColumns({x: F.col(x).cast("double"), y: F.col(y).cast("double")})
    model = IsotonicRegression(featuresCol=x, labelCol=y, isotonic=rising, predictionCol=name, **options).fit(data)
    return model.transform(data)
