"""Strata, folds and keyed draws."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from patchloom.functions.random import uniform
from patchloom.operators.rank import interval, pieces

#: Donors of all pools together that go to every task as arrays (16 bytes each and 8 more for each further target).
MOST_DONORS = 2_000_000


def strata(df: DataFrame, y: str, tiles: int, id_col: str, name: str = "stratum") -> DataFrame:
    """Adds the ntile of y, ties by id: equal-sized buckets in order.

    The rank is counted from the sizes of value ranges, so no task holds all rows: rows are dealt out
    by approximate quantiles of y, ranked inside their range, and shifted by the rows of the ranges before.
    """
    cuts = sorted(set(df.where(F.col(y).isNotNull()).approxQuantile(y, [k / 64 for k in range(1, 64)], 0.01)))
    held = df.withColumn("_part", F.when(F.col(y).isNull(), -1).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(y)))) if cuts else F.lit(0))
    sizes = {r["_part"]: r["count"] for r in held.groupBy("_part").count().collect()}  # at most 65 rows
    total, before, shift = sum(sizes.values()), {}, 0
    for part in sorted(sizes):
        before[part] = shift
        shift += sizes[part]
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(y, id_col))
    start = F.lit(0)
    for part, s in before.items():
        start = F.when(F.col("_part") == part, F.lit(s)).otherwise(start)
    r = rank + start - 1
    big, small = total % tiles, total // tiles  # the first `big` tiles have one row more
    tile = F.when(r < big * (small + 1), F.floor(r / (small + 1))).otherwise(big + F.floor((r - big * (small + 1)) / max(1, small)))
    return held.withColumn(name, (tile + 1).cast("int")).drop("_part")


def _shuffled(df: DataFrame, stratum: str, tag: str, id_col: str) -> DataFrame:
    """Adds _rank, the place of a row in its stratum by keyed uniforms, from 1, and _n, the stratum's rows.

    Rows are ranked inside equal pieces of [0, 1), as many as the rows ask for, and moved by the rows of the pieces before, so a stratum is no task's alone.
    """
    cell = Window.partitionBy("_s", "_piece")
    held = df.withColumn("_u", uniform(tag, id_col)).withColumn("_piece", F.floor(F.col("_u") * pieces(df.count())))
    sizes = held.groupBy(F.col(stratum).alias("_s"), "_piece").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("_s").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_s", F.col("_piece").alias("_p"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"), F.sum("_c").over(Window.partitionBy("_s")).alias("_n"))
    met = held.join(starts, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_piece") == F.col("_p")))
    return met.withColumn("_rank", F.col("_start") + F.row_number().over(cell.orderBy("_u", id_col))).drop("_s", "_p", "_u", "_piece", "_start")


def stratified_sample(df: DataFrame, stratum: str, share: float, tag: str, id_col: str) -> DataFrame:
    """Keeps, in each stratum, the round(share * N) rows of the least keyed uniforms."""
    return _shuffled(df, stratum, tag, id_col).where(F.col("_rank") <= F.round(F.lit(share) * F.col("_n"))).drop("_rank", "_n")


def k_folds(df: DataFrame, stratum: str, folds: int, tag: str, id_col: str, name: str = "fold") -> DataFrame:
    """Adds a fold from 1 to folds, balanced in each stratum, by the order of keyed uniforms: the first folds have one row more."""
    big, small = F.col("_n") % folds, F.floor(F.col("_n") / folds)
    r = F.col("_rank") - 1
    fold = F.when(r < big * (small + 1), F.floor(r / (small + 1))).otherwise(big + F.floor(F.try_divide(r - big * (small + 1), small)))
    return _shuffled(df, stratum, tag, id_col).withColumn(name, (fold + 1).cast("int")).drop("_rank", "_n")


def implicates(df: DataFrame, m: int, m_col: str = "M") -> DataFrame:
    """Each row m times, with the implicate number: a narrow expansion, no join."""
    return df.withColumn(m_col, F.explode(F.sequence(F.lit(1), F.lit(m))))


def zero_draw(p_zero: Column, u: Column) -> Column:
    """True where the simulated value is zero."""
    return u < p_zero


def categorical_draw(probabilities: Sequence[Column], levels: Sequence[str], u: Column) -> Column:
    """The level at the number of cumulative probabilities below u."""
    code, total = F.lit(0), F.lit(0.0)
    for p in probabilities[:-1]:
        total = total + p
        code = code + (u > total).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in levels]), code + 1)


def text_cuts(df: DataFrame, column: str, ranges: int, each: int = 16) -> list:
    """Rising values that cut a column into about equal ranges: every sixteenth of those with the least hashes, 16 a range."""
    drawn = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"), F.xxhash64(column).alias("h")).distinct().orderBy("h", "v").limit(ranges * each)
    return sorted(r.v for r in drawn.collect())[each - 1 : -1 : each]


def text_interval(column: str, cuts: Sequence) -> Column:
    """The number of rising cuts below the value, by halves, for values of any type that can be ordered; null for null."""

    def halves(lo: int, hi: int) -> Column:
        k = (lo + hi) // 2
        return F.lit(lo) if lo == hi else F.when(F.col(column) <= F.lit(cuts[k]), halves(lo, k)).otherwise(halves(k + 1, hi))

    return F.when(F.col(column).isNotNull(), halves(0, len(cuts)))


def donor_draw(recipients: DataFrame, donors: DataFrame, cluster: str, donor_weight: str, values: Sequence[str], u: Column, id_col: str, donor_id: str) -> DataFrame:
    """Draws for each recipient a donor of its cluster, with replacement and in proportion to weight, and copies its values jointly.

    Donors' cumulative weights and the scaled draws meet in a merge by cluster: both are ordered by
    position, and each draw takes the first donor whose interval ends beyond it. A cluster is merged in
    pieces of equal weight, as many as the rows ask for, each of which begins with the first donor of the pieces after it.
    Donors are dealt out by ranges of their ids before their weights are added up.
    Donors of no weight are never drawn.
    """
    numeric = isinstance(donors.schema[donor_id].dataType, NumericType)
    held = donors.count()
    ranges, n = pieces(held), pieces(max(held, recipients.count()))
    if numeric:
        part = interval(donor_id, sorted(set(donors.approxQuantile(donor_id, [k / ranges for k in range(1, ranges)], 0.2 / ranges))))
    else:
        part = text_interval(donor_id, text_cuts(donors, donor_id, ranges))
    own = donors.select(cluster, F.col(donor_id).alias("_donor"), *values, F.col(donor_weight).alias("_w"), part.alias("_part"))
    sums = own.groupBy(F.col(cluster).alias("_c"), F.col("_part").alias("_p")).agg(F.sum("_w").alias("_w_part"))
    before = Window.partitionBy("_c").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_c", "_p", F.coalesce(F.sum("_w_part").over(before), F.lit(0)).alias("_start"), F.sum("_w_part").over(Window.partitionBy("_c")).cast("double").alias("_all"))
    order = Window.partitionBy(cluster, "_part").orderBy("_donor").rowsBetween(Window.unboundedPreceding, 0)
    cum = own.join(starts, (F.col(cluster) == F.col("_c")) & (F.col("_part") == F.col("_p")))
    piece = lambda pos: F.least(F.floor(F.try_divide(pos, F.col("_all")) * n), F.lit(n - 1))
    cum = cum.withColumn("_pos", (F.col("_start") + F.sum("_w").over(order)).cast("double")).withColumn("_piece", piece(F.col("_pos")))
    totals = donors.groupBy(cluster).agg(F.sum(donor_weight).cast("double").alias("_all"))
    drawn = recipients.withColumn("_u", u).join(totals, cluster).withColumn("_pos", F.col("_u") * F.col("_all")).withColumn("_piece", piece(F.col("_pos")))
    ends = cum.select(cluster, "_piece", "_pos", F.lit(1).alias("_kind"), F.struct("_donor", *values).alias("_d"), F.lit(None).cast(recipients.schema[id_col].dataType).alias(id_col))
    asks = drawn.select(cluster, "_piece", "_pos", F.lit(0).alias("_kind"), F.lit(None).cast(ends.schema["_d"].dataType).alias("_d"), id_col)
    # the first donor that ends in a piece also serves the end of every piece before, back to the one where the last donor ended
    firsts = ends.groupBy(cluster, "_piece").agg(F.min(F.struct("_pos", "_d._donor")).alias("_least"), F.min_by("_d", F.struct("_pos", "_d._donor")).alias("_d"))
    last = F.lag("_piece", 1, 0).over(Window.partitionBy(cluster).orderBy("_piece"))
    carried = firsts.withColumn("_from", last).where(F.col("_piece") > F.col("_from")).select(cluster, F.explode(F.sequence("_from", F.col("_piece") - 1)).alias("_piece"), F.lit(float("inf")).alias("_pos"), F.lit(1).alias("_kind"), "_d", F.lit(None).cast(recipients.schema[id_col].dataType).alias(id_col))
    ahead = Window.partitionBy(cluster, "_piece").orderBy(F.desc("_pos"), "_kind", F.desc("_d._donor")).rowsBetween(Window.unboundedPreceding, 0)
    # a draw at exactly a donor's end belongs to the next donor: ends sort after asks in falling order
    found = ends.unionByName(carried).unionByName(asks).withColumn("_found", F.last("_d", ignorenulls=True).over(ahead)).where("_kind = 0")
    return found.select(id_col, cluster, F.col("_found._donor").alias(donor_id), *[F.col(f"_found.{v}").alias(v) for v in values])


def pool_draw(df: DataFrame, donors: DataFrame, cid: str, weight: str, targets: Sequence[str], u: str, donor_id: str) -> DataFrame | None:
    """Adds the targets of a donor drawn for each row from its cluster's pool by weight, as donor_draw picks it; None where the pools are too large.

    Pools of up to MOST_DONORS rows are counted, sent to every task, and searched there by running weight, so no row of df moves. A row
    without a pool gets nulls. Targets pass through doubles.
    """
    held = donors.select(cid, donor_id, F.col(weight).cast("double").alias("_w"), *[F.col(t).cast("double").alias(t) for t in targets])
    if held.limit(MOST_DONORS + 1).count() > MOST_DONORS:
        return None
    pdf = held.toPandas().sort_values([cid, donor_id])
    names, start = np.unique(pdf[cid].to_numpy(), return_index=True)
    upto = np.cumsum(pdf["_w"].to_numpy(float))
    end = np.append(start[1:], len(pdf))
    before = np.concatenate(([0.0], upto))[start]
    sent = df.sparkSession.sparkContext.broadcast((names, start, end, upto, before, pdf[list(targets)].to_numpy(float)))

    def draw(own: pd.Series, place: pd.Series) -> pd.DataFrame:
        names, start, end, upto, before, values = sent.value
        out = np.full((len(own), len(targets)), np.nan)
        wanted, at = pd.to_numeric(own).to_numpy(float), place.to_numpy(float)
        k = np.minimum(np.searchsorted(names, wanted), max(0, len(names) - 1))
        good = np.flatnonzero(names[k] == wanted) if len(names) else np.zeros(0, int)
        k = k[good]
        total = upto[end[k] - 1] - before[k]
        pick = np.searchsorted(upto, before[k] + at[good] * total, "right")
        out[good] = values[np.clip(pick, start[k], end[k] - 1)]
        return pd.DataFrame({f"t{j}": pd.Series(out[:, j]).where(np.isfinite(out[:, j]), None) for j in range(len(targets))})

    types = ", ".join(f"t{j} double" for j in range(len(targets)))
    found = df.withColumn("_drawn", F.pandas_udf(draw, types)(F.col(cid), F.col(u)))
    return found.select(*df.columns, *[F.col(f"_drawn.t{j}").cast(donors.schema[t].dataType).alias(t) for j, t in enumerate(targets)])
