"""Choosing imputation's predictors: columns of every type as ranks that can be correlated, and the best of each target."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from patchloom.operators.rank import ranked
from patchloom.sources.scratch import stored

#: Least |r| of a predictor, predictors of a target at most, and those kept in any case.
LEAST_R, MOST, LEAST = 0.025, 30, 5


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The most frequent value of each column as text, the least of several; columns of nulls alone are missing. One pass for all."""
    if not columns:
        return {}
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(cells.alias("_c")).select("_c.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("best"))
    return {r.column: r.best.value for r in best.collect()}  # a row for each column


def plausible_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a column each, double, without nulls): numbers as dense ranks, logicals as 0 or 1, other values as whether they are the most frequent one.

    Nulls and NaN are the median of a column's ranks or flags. Columns of nulls alone are 0. All medians come from one
    aggregation over the ranks: the median rank belongs to the least value with half of the rows up to it.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    numbers = [c for c in columns if isinstance(kinds[c], NumericType)]
    others = [c for c in columns if c not in numbers and not isinstance(kinds[c], BooleanType)]
    mode = modes(df, others)

    def coded(c: str):
        if c in numbers:
            return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        if isinstance(kinds[c], BooleanType):
            return F.col(c).cast("double")
        return (F.col(c).cast("string") == F.lit(mode.get(c))).cast("double")

    held = df.select(*[coded(c).alias(f"_v{k}") for k, c in enumerate(columns)])
    order = [k for k, c in enumerate(columns) if c in numbers]
    if order:
        held = stored(ranked(held, [f"_v{k}" for k in order], dense=[f"_d{k}" for k in order], upto=[f"_u{k}" for k in order]), "ranks")
    counts = held.agg(*[F.count(f"_v{k}").alias(f"n{k}") for k in range(len(columns))], *[F.sum(f"_v{k}").alias(f"s{k}") for k in range(len(columns)) if k not in order]).collect()[0]
    middle, facts = [], {}
    for k in range(len(columns)):
        n = counts[f"n{k}"]
        if k in order:
            at = lambda place, k=k: F.min(F.when(F.col(f"_u{k}") >= place, F.col(f"_d{k}")))
            middle += [((at((n + 1) // 2) + at(n // 2 + 1)) / 2).alias(f"m{k}"), F.max(f"_d{k}").cast("double").alias(f"t{k}")]
        elif n:
            ones = counts[f"s{k}"]
            facts[k] = 1.0 if 2 * ones > n else 0.5 if 2 * ones == n else 0.0
    found = held.agg(*middle).collect()[0] if middle else None
    out = []
    for k, c in enumerate(columns):
        if k in order:
            value = F.coalesce(F.col(f"_d{k}").cast("double"), F.lit(found[f"m{k}"]), F.lit(0.0))
        else:
            value = F.coalesce(F.col(f"_v{k}"), F.lit(facts.get(k, 0.0)))
        out.append(value.alias(c))
    return held.select(*out)


def correlations(ranks: DataFrame) -> np.ndarray:
    """The columns' correlation matrix from one pass; 0 where a column has one value. Columns are moved and scaled first, which loses no digits to large ranks."""
    columns = ranks.columns
    ends = ranks.agg(*[F.min(F.col(f"`{c}`")).alias(f"a{k}") for k, c in enumerate(columns)], *[F.max(F.col(f"`{c}`")).alias(f"b{k}") for k, c in enumerate(columns)]).collect()[0]
    if ends["a0"] is None:
        return np.zeros((len(columns), len(columns)))
    spans = [(ends[f"a{k}"], max(ends[f"b{k}"] - ends[f"a{k}"], 1.0)) for k in range(len(columns))]
    scaled = ranks.select(*[((F.col(f"`{c}`") - a) / b - (0.0 if ends[f"b{k}"] == a else 0.5)).alias(f"_c{k}") for k, (c, (a, b)) in enumerate(zip(columns, spans, strict=True))])
    if ranks.limit(2).count() < 2:
        return np.zeros((len(columns), len(columns)))
    vectors = VectorAssembler(inputCols=scaled.columns, outputCol="_x").transform(scaled).select("_x")
    return np.nan_to_num(Correlation.corr(vectors, "_x").collect()[0][0].toArray())  # columns x columns


def impute_screen(df: DataFrame, targets: Sequence[str], columns: Sequence[str], threshold: float = LEAST_R, most: int = MOST, least: int = LEAST) -> DataFrame:
    """(y, x, r): the predictors among columns of each target, by correlations of plausible ranks over all rows.

    Those with |r| above the threshold are taken, the `most` best at most; if fewer than `least` pass, the `least`
    best. Ties go to the lesser name. Nulls anywhere are the medians of ranks, columns of one value have r = 0, an
    empty table gives r = 0 everywhere. No column may be in targets or columns twice.
    """
    names = list(dict.fromkeys([*targets, *columns]))
    matrix = correlations(plausible_ranks(df, names))
    place = {c: k for k, c in enumerate(names)}
    rows = [(y, x, float(matrix[place[y], place[x]])) for y in targets for x in columns if x != y]
    found = df.sparkSession.createDataFrame(rows, "y string, x string, r double")
    order = Window.partitionBy("y").orderBy(F.desc(F.abs("r")), "x")
    passed = F.sum((F.abs("r") > threshold).cast("int")).over(Window.partitionBy("y"))
    held = found.withColumns({"_k": F.row_number().over(order), "_n": passed})
    return held.where(F.col("_k") <= F.when(F.least(F.col("_n"), F.lit(most)) < least, F.lit(least)).otherwise(F.least(F.col("_n"), F.lit(most)))).select("y", "x", "r")
