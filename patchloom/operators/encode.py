"""Coding of categories, frequency tables and simple imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions.random import uniform


def one_hot(df: DataFrame, column: str, levels: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., y, level, value): a row for each level, value 1 where the row has it; nulls have none. y and level stay apart, so names can't collide."""
    levels_ = F.array(*[F.struct(F.lit(v).alias("level"), F.col(column).eqNullSafe(F.lit(v)).cast("int").alias("value")) for v in levels])
    return df.select(*keep, F.lit(column).alias("y"), F.explode(levels_).alias("_l")).select(*keep, "y", "_l.level", "_l.value")


def weighted_table(df: DataFrame, column: str, weight: str | Column | None = None, drop_null: bool = False) -> DataFrame:
    """(column, freq): the sum of weights (or the count) of each value."""
    w = F.lit(1) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    return (df.where(F.col(column).isNotNull()) if drop_null else df).groupBy(column).agg(F.sum(w).alias("freq"))


def lump_levels(df: DataFrame, column: str, most: int, weight: str | None = None, other: str = "_Other_") -> DataFrame:
    """Keeps the most - 1 heaviest values if there are `most` or more, and calls the rest, nulls too, `other`. Ties go to the lesser value."""
    freq = weighted_table(df, column, weight, drop_null=True).withColumnRenamed("freq", "_f")
    top = freq.orderBy(F.desc("_f"), column).limit(most)
    held = [r[0] for r in top.collect()]  # at most `most` values
    if len(held) < most:
        return df
    return df.withColumn(column, F.when(F.col(column).isin(held[: most - 1]), F.col(column)).otherwise(F.lit(other)))


def mode_indicator(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds name: 1 where the value is the most frequent one (the least of several)."""
    top = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(1).collect()
    return df.withColumn(name, F.coalesce((F.col(column) == F.lit(top[0][0])).cast("int"), F.lit(0)) if top else F.lit(0))


def impute_simple(df: DataFrame, numeric: Sequence[str], nominal: Sequence[str], id_col: str) -> DataFrame:
    """Fills numeric nulls with the median and nominal ones by a draw from the observed frequencies, keyed by the id."""
    if numeric:
        medians = df.agg(*[F.percentile(c, 0.5).alias(c) for c in numeric]).collect()[0]
        df = df.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c]).cast(df.schema[c].dataType)) for c in numeric})
    for c in nominal:
        freq = weighted_table(df, c, drop_null=True)
        order = Window.orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
        share = [(r[0], r.cum) for r in freq.withColumn("cum", F.sum("freq").over(order) / F.sum("freq").over(Window.partitionBy())).orderBy(c).collect()]  # a row for each level
        u, drawn = uniform(f"impute|{c}", id_col), F.lit(share[-1][0]) if share else F.lit(None)
        for value, cum in reversed(share[:-1]):
            drawn = F.when(u < cum, F.lit(value)).otherwise(drawn)
        df = df.withColumn(c, F.coalesce(F.col(c), drawn))
    return df
