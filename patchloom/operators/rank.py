"""Ranks over whole tables without a single-task window, and rank correlations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.sources.scratch import stored

#: Rows that a piece of a table is to have, and pieces at least and at most.
PIECE_ROWS, LEAST_PIECES, MOST_PIECES = 500_000, 64, 4096
#: Distinct values of a column, and of all columns together, up to which their ranks are sent to the tasks.
BROADCAST_VALUES, BROADCAST_TOTAL = 200_000, 1_000_000


def pieces(rows: int) -> int:
    """Pieces or ranges to work in, from the rows there are."""
    return max(LEAST_PIECES, min(MOST_PIECES, -(-rows // PIECE_ROWS)))


def interval(column: str, cuts: Sequence[float]) -> Column:
    """The number of rising cuts below the value, by halves; null for null. One SQL text, since a Column object a cut takes the driver long."""

    def halves(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        k = (lo + hi) // 2
        return f"CASE WHEN `{column}` <= double('{float(cuts[k])!r}') THEN {halves(lo, k)} ELSE {halves(k + 1, hi)} END"

    return F.expr(f"CASE WHEN `{column}` IS NOT NULL THEN {halves(0, len(cuts))} END")


def _value_ranks(base: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[int]]:
    """(_c, _v, _n, _upto, _dense): each distinct value of columns of one type, by the column's place, with its rows and the rows and values up to it; and the values there are of each column.

    One pass over the rows counts all columns' values, combined before the shuffle. What follows works on values, dealt out by ranges of about even size.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("_c"), F.col(c).alias("_v")) for k, c in enumerate(columns)]))
    counts = stored(base.select(cells.alias("_x")).select("_x.*").where("_v IS NOT NULL").groupBy("_c", "_v").agg(F.count("*").alias("_n")), "values")
    dealt = stored(counts.repartitionByRange(pieces(counts.count()), "_c", "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    before, distinct, rows = [], [0] * len(columns), [0] * len(columns)
    for r in dealt.groupBy("_c", "_part").agg(F.sum("_n").alias("n"), F.count("*").alias("d")).orderBy("_c", "_part").collect():  # ranges + columns rows at most
        before.append((r["_c"], r["_part"], rows[r["_c"]], distinct[r["_c"]]))
        rows[r["_c"]] += r.n
        distinct[r["_c"]] += r.d
    offsets = base.sparkSession.createDataFrame(before, "_c int, _part int, _rows long, _values long")
    order = Window.partitionBy("_c", "_part").orderBy("_v")
    upto = F.col("_rows") + F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(offsets), ["_c", "_part"]).select("_c", "_v", "_n", upto.alias("_upto"), (F.col("_values") + F.row_number().over(order)).alias("_dense")), distinct


def ranked(df: DataFrame, columns: str | Sequence[str], dense: str | Sequence[str] = (), average: str | Sequence[str] = (), upto: str | Sequence[str] = (), kept: bool = False) -> DataFrame:
    """Adds the dense ranks, the average ranks and/or the numbers of rows up to a value of numeric columns over the whole table, by the names given; nulls have none.

    The input is stored once, since it is read to count values and to join them, unless the caller has kept it. Ranks are worked out for the distinct
    values and joined back: a frequent value is one row. The values of columns that have few go to the tasks, and no row moves for them.
    """
    columns, dense, average, upto = ([c] if isinstance(c, str) else list(c) for c in (columns, dense, average, upto))
    base = df if kept else stored(df, "ranked")
    types = {c: base.select(c).schema[0].dataType for c in columns}
    found = []  # (values, place, ranks by column)
    for kind in dict.fromkeys(types.values()):  # values of one type are compared as they are
        own = [k for k, c in enumerate(columns) if types[c] == kind]
        ranks, distinct = _value_ranks(base, [columns[k] for k in own])
        found += [(n, k, ranks.where(F.col("_c") == at)) for at, (k, n) in enumerate(zip(own, distinct, strict=True))]
    out, left = base, BROADCAST_TOTAL
    for n, k, ranks in sorted(found, key=lambda f: f[:2]):
        new = {}
        if dense:
            new[dense[k]] = F.col("_dense")
        if average:
            new[average[k]] = F.col("_upto") - (F.col("_n") - 1) / 2
        if upto:
            new[upto[k]] = F.col("_upto")
        values = ranks.select(F.col("_v").alias("_value"), *[v.alias(name) for name, v in new.items()])
        few = n <= min(BROADCAST_VALUES, left)
        left -= n if few else 0
        out = out.join(F.broadcast(values) if few else values, F.col(columns[k]) == F.col("_value"), "left").drop("_value")
    return out.select(*[f"`{c}`" for c in base.columns], *[names[k] for k in range(len(columns)) for names in (dense, average, upto) if names])


def spearman(df: DataFrame, ys: Sequence[str], xs: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """(y, x, r): rank correlations of every target with every predictor over the rows where both are there, null where one of them is constant; from one pass over the ranks.

    flags are columns of two values, which correlate as their ranks do and need none. Each task sums its rows' products as matrices, since an aggregate
    function for each pair would be too long for Java to compile. What is gathered grows with targets x predictors alone.
    """
    columns = list(dict.fromkeys([*ys, *xs]))
    base = stored(df.select(*columns), "ranked")
    n = float(base.count())
    order = [c for c in columns if c not in flags]
    held = {c: c if c in flags else f"_r_{c}" for c in columns}
    table = ranked(base, order, average=[held[c] for c in order], kept=True) if order else base
    center, scale = (np.array([v if c in order else w for c in columns]) for v, w in (((n + 1) / 2, 0.0), (max(n, 1.0), 1.0)))
    left, right = [columns.index(y) for y in ys], [columns.index(x) for x in xs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, len(left), len(right)))
        for b in batches:
            v = (np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float) - center) / scale
            there = ~np.isnan(v)
            v[~there] = 0.0
            y, x, my, mx = v[:, left].T, v[:, right], there[:, left].T.astype(float), there[:, right].astype(float)
            sums += [my @ mx, y @ mx, my @ x, (y * y) @ mx, my @ (x * x), y @ x]
        yield pa.RecordBatch.from_arrays([pa.array([sums.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = table.select(*[F.col(held[c]).cast("double") for c in columns]).mapInArrow(run, "sums array<double>")
    total = np.zeros(6 * len(left) * len(right))
    for r in parts.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():  # matrices' cells
        total[r["at"]] = r.v
    k, sy, sx, yy, xx, xy = total.reshape(6, len(left), len(right))
    k = np.maximum(k, 1.0)
    vy, vx = (np.where((v := s2 - s * s / k) > 1e-13 * s2, v, np.nan) for s, s2 in ((sy, yy), (sx, xx)))
    r = (xy - sy * sx / k) / np.sqrt(vy * vx)
    rows = [(y, x, None if np.isnan(r[i, j]) else float(r[i, j])) for i, y in enumerate(ys) for j, x in enumerate(xs)]
    return df.sparkSession.createDataFrame(rows, "y string, x string, r double")


def screened(correlations: DataFrame, threshold: float = 0.05, at_least: int = 20) -> DataFrame:
    """The predictors of each target with |r| above the threshold, or its at_least best if fewer pass."""
    order = Window.partitionBy("y").orderBy(F.desc(F.abs("r")), "x")
    passed = F.sum((F.abs("r") > threshold).cast("int")).over(Window.partitionBy("y"))
    held = correlations.withColumns({"_k": F.row_number().over(order), "_n": passed})
    return held.where(F.when(F.col("_n") >= at_least, F.abs("r") > threshold).otherwise(F.col("_k") <= at_least)).select("y", "x", "r")
