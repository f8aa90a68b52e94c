"""Order of fusion and predictors for each target, from small matrices gathered over the donors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.operators.encode import weighted_table
from patchloom.operators.fusion import all_inflated, kind_of
from patchloom.operators.rank import ranked, screened
from patchloom.sources.scratch import stored

#: Values of a category beyond which the lighter ones are lumped, predictors that a target gets at least, and the lumped values' name.
LEVELS, AT_LEAST, OTHER = 5, 20, "_Other_"


@dataclass
class Coded:
    """A numeric column of the coded table: a number, a flag of a category's value, or a flag of non-zero values (suffix _zero)."""

    name: str
    origin: str
    value: Column
    flag: bool
    ends: tuple[float, float] | None  # least and greatest value; None if it has one value or none


def lasso_path(r: np.ndarray, c: np.ndarray, most: int = 100, steps: int = 30) -> tuple[list[tuple[np.ndarray, float]], bool]:
    """([(coefficients, r squared)], whole) along falling penalties, by coordinate descent on a correlation matrix.

    The path ends, and isn't whole, before more than `most` predictors are used.
    """
    top = np.abs(c).max() if len(c) else 0.0
    b, out = np.zeros(len(c)), []
    for lam in top * np.logspace(0, -3, steps):
        for _ in range(100):
            old = b.copy()
            for j in range(len(c)):
                z = c[j] - r[j] @ b + b[j]
                b[j] = np.sign(z) * max(0.0, abs(z) - lam)
            if np.abs(b - old).max(initial=0) < 1e-6:
                break
        if np.count_nonzero(b) > most:
            return out, False
        out.append((b.copy(), float(2 * c @ b - b @ r @ b)))
    return out, True


def levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[tuple[str, int]]]:
    """Each column's LEVELS most frequent values and their rows, ties to the lesser value. One job for all columns."""
    if not columns:
        return {}
    top = [weighted_table(df, c, drop_null=True).orderBy(F.desc("freq"), c).limit(LEVELS).select(F.lit(c).alias("column"), F.col(c).alias("value"), "freq") for c in columns]
    out: dict[str, list[tuple[str, int]]] = {c: [] for c in columns}
    for r in sorted(reduce(DataFrame.unionAll, top).collect(), key=lambda r: (-r.freq, r.value)):  # LEVELS rows a column at most
        out[r.column].append((r.value, r.freq))
    return out


def coded(df: DataFrame, x: Sequence[str], y: Sequence[str], inflated: Sequence[str] = ()) -> list[Coded]:
    """The numeric columns that stand for x and y: one for numbers and booleans, one for each value of a category after lumping. Null numbers of x are medians.

    Values are counted and ends found in one pass each, so no constant column has to be written to be seen as one.
    """
    columns, n = [*x, *y], df.count()
    kinds = {c: kind_of(df, c) for c in columns}
    held = levels(df, [c for c in columns if kinds[c] == "category"])
    numbers = [c for c in columns if kinds[c] != "category"]
    v = {c: F.col(c).cast("double") for c in numbers}
    ends = dict(zip(numbers, df.agg(*[F.struct(F.count(v[c]).alias("n"), F.min(v[c]).alias("a"), F.max(v[c]).alias("b"), (F.min(v[c]) < F.max(v[c])).alias("spread")).alias(c) for c in numbers]).collect()[0], strict=True)) if numbers else {}
    gaps = [c for c in x if c in ends and 0 < ends[c].n < n]
    medians = df.agg(*[F.percentile_approx(v[c], 0.5).alias(c) for c in gaps]).collect()[0] if gaps else {}
    out = []
    for c in columns:
        if kinds[c] == "category":
            lumped = len(held[c]) == LEVELS
            rows = {value: k for value, k in held[c][: LEVELS - 1] if not (lumped and value == OTHER)}
            rest = list(rows)
            if lumped:
                rows[OTHER] = n - sum(rows.values())
            for value in sorted(rows):
                there = F.col(c).isNull() | ~F.col(c).isin(rest) if lumped and value == OTHER else F.col(c) == value
                out.append(Coded(f"{c}..{value}", c, F.coalesce(there.cast("double"), F.lit(0.0)), True, (0.0, 1.0) if 0 < rows[value] < n else None))
        else:
            value = F.coalesce(v[c], F.lit(medians[c])) if c in gaps else v[c]
            out.append(Coded(c, c, value, kinds[c] == "binary", (ends[c].a, ends[c].b) if ends[c].spread else None))
            if c in inflated:
                out.append(Coded(f"{c}_zero", c, (F.col(c) != 0).cast("double"), True, (0.0, 1.0)))
    return out


def correlations(df: DataFrame, columns: Sequence[str], weight: str, only: Sequence[str] = (), ends: Sequence[tuple[float, float]] | None = None, plain: bool = False) -> tuple[np.ndarray, dict[str | None, np.ndarray]]:
    """(weighted means, {name: weighted correlation matrix}): over all rows under "", and over the rows where a column of `only` isn't 0 under its name; plain: over all rows without weights under None.

    One pass: each task sums the products of its rows, so what is gathered grows with the square of the columns alone.
    Columns are moved and scaled by their ends, which another pass finds unless they are given.
    """
    p, kept = len(columns), ["", *only, *([None] if plain else [])]
    if ends is None:
        first = df.agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(f"m{k}") for k, c in enumerate(columns)]).collect()[0]
        ends = [(r.a or 0.0, r.b or 0.0) for r in first]
    center = np.array([(a + b) / 2 for a, b in ends], float)
    scale = np.array([(b - a) or 1.0 for a, b in ends], float)
    masks = [list(columns).index(c) for c in only]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(kept), p + 1, p + 1))
        for b in batches:
            x = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(p + 1)]).astype(float)
            w, z = x[:, p], np.column_stack([np.ones(len(x)), (x[:, :p] - center) / scale])
            for k in range(len(kept)):
                own = w if k == 0 else w * (x[:, masks[k - 1]] != 0) if k <= len(masks) else None
                sums[k] += z.T @ (z if own is None else z * own[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(kept)), pa.int32()), pa.array([s.ravel().tolist() for s in sums], pa.list_(pa.float64()))], names=["of", "sums"])

    parts = df.select(*columns, weight).mapInArrow(run, "of int, sums array<double>")
    total = np.zeros((len(kept), (p + 1) ** 2))
    for r in parts.select("of", F.posexplode("sums").alias("at", "v")).groupBy("of", "at").agg(F.sum("v").alias("v")).collect():  # matrices' cells
        total[r.of, r["at"]] = r.v
    out = {}
    for k, name in enumerate(kept):
        g = total[k].reshape(p + 1, p + 1)
        mean = g[0, 1:] / (g[0, 0] or 1.0)
        cov = g[1:, 1:] / (g[0, 0] or 1.0) - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
        sd[sd < 1e-9] = np.inf  # constant there: correlated with nothing
        out[name] = cov / np.outer(sd, sd)
        if k == 0:
            means = mean * scale + center
    return means, out


def prepare(
    df: DataFrame, y: Sequence, x: Sequence[str], weight: str | None = None, cor_thresh: float = 0.05, lasso_thresh: float = 0.95, xmax: int = 100, xforce: Sequence[str] = (), fraction: float = 1.0, seed: int = 1
) -> tuple[list, dict[str, list[str]]]:
    """(order of targets, predictors by target): screens by rank correlation, then adds the block of targets best explained by x and the targets before it.

    Categories are lumped to five values and coded by flags; the r squared of a category is the sum of its flags', by their share
    of the weights. A zero-inflated target is explained where it isn't 0, and a flag of that is one more target of its block. A target's
    predictors are its block's: those with a coefficient at the chosen penalty, at least 20 if so many are there, and xforce.
    No model takes more than xmax columns. fraction < 1 looks at a random part of the rows, if the caller asks for it.

    Rows with a null target or weight are left out; a null number of x is its median, a null category no value (or a lumped one).
    Constant columns are left out. One pass counts the numbers' values, from which ranks come, and one gives the ranks' and the values' correlations; the search needs only those matrices.
    """
    blocks = [[b] if isinstance(b, str) else list(b) for b in y]
    ys = [t for b in blocks for t in b]
    if not ys or not x or set(ys) & set(x) or len(set(ys)) < len(ys) or not all(blocks):
        raise ValueError("y and x must not be empty, and targets must be distinct and no predictors")
    if not set(xforce) <= set(x):
        raise ValueError("xforce must be predictors")
    if not (xmax >= 1 and 0 < fraction <= 1 and 0 < cor_thresh <= 1 and 0 < lasso_thresh <= 1):
        raise ValueError("xmax is 1 or more; fraction, cor_thresh and lasso_thresh are above 0 and at most 1")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    names = {c: f"c{k}" for k, c in enumerate([*x, *ys])}  # names of our own can't clash
    back = {v: c for c, v in names.items()}
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], w.alias("w")).dropna(subset=[*(names[t] for t in ys), "w"])
    rows = stored(rows.sample(fraction=fraction, seed=seed) if fraction < 1 else rows, "rows")
    inflated = all_inflated(rows, [names[t] for t in ys if kind_of(rows, names[t]) == "number"])
    at = {f"v{k}": c for k, c in enumerate(c for c in coded(rows, [names[c] for c in x], [names[t] for t in ys], inflated) if c.ends)}
    own: dict[str, list[str]] = {}  # coded columns by column
    for v, c in at.items():
        own.setdefault(c.origin, []).append(v)
    ycols, xcols = ([v for c in some for v in own.get(names[c], [])] for some in (ys, x))
    blocks = [b for b in ([t for t in b if names[t] in own] for b in blocks) if b]
    if not xcols or not blocks:
        raise ValueError("all targets or all predictors are constant")

    table = rows.select(*[c.value.alias(v) for v, c in at.items()], "w")  # cheaper to work out again than to write
    order = [v for v, c in at.items() if not c.flag]
    rank_of = {v: f"r{v}" for v in order}
    everything, ends = [*at, *rank_of.values()], [c.ends for c in at.values()] + [(1.0, float(rows.count()))] * len(order)
    values = [v for v, c in at.items() if c.name in inflated]
    means, matrices = correlations(ranked(table, order, average=list(rank_of.values()), kept=True) if order else table, everything, "w", values, ends, plain=True)
    index = {v: k for k, v in enumerate(everything)}
    spearman = [(y, x, float(matrices[None][index[rank_of.get(y, y)], index[rank_of.get(x, x)]])) for y in ycols for x in xcols]  # flags correlate as their ranks do
    passed: dict[str, list[str]] = {v: [] for v in ycols}
    for r in sorted(screened(df.sparkSession.createDataFrame(spearman, "y string, x string, r double"), cor_thresh, AT_LEAST).collect(), key=lambda r: (-abs(r.r), xcols.index(r.x))):  # columns of y * columns of x rows at most
        passed[r.y].append(r.x)

    def best(v: str, xs: list[str], chosen: float) -> tuple[float, list[str]]:
        matrix, k = matrices[v if v in values else ""], [index[c] for c in xs]
        path, whole = lasso_path(matrix[np.ix_(k, k)], matrix[k, index[v]], xmax)
        most = max((r2 for _, r2 in path), default=0.0)
        if most <= 0:
            return 0.0, []
        b, r2 = next((b, r2) for b, r2 in path if r2 >= (chosen if whole else 1.0) * most)
        return r2, [c for c, used in zip(xs, b, strict=True) if used]

    def targets(t: str) -> list[list[str]]:
        """What stands for a target: its flags together, or its value and then the flag of non-zero values."""
        mine = own[names[t]]
        return [mine] if kind_of(rows, names[t]) == "category" else [[v] for v in mine]

    def explained(block: list[str], extra: list[str], chosen: float) -> tuple[float, list[str]]:
        scores, used = [], []
        for group in (g for t in block for g in targets(t)):
            total = 0.0
            for v in group:
                xs = passed[v] + [c for c in extra if c not in group]
                r2, kept = best(v, xs, chosen)
                total += r2 * (means[index[v]] if len(group) > 1 else 1.0)
                used += kept + [c for c in passed[v] if c not in kept][: max(0, AT_LEAST - len(kept))]
            scores.append(total)
        return float(np.mean(scores)), used

    others = lambda b: [c for c in ycols if back[at[c].origin] not in b]
    full = [max(1e-12, explained(b, others(b), 1.0)[0]) for b in blocks]
    left, order, predictors, done = list(range(len(blocks))), [], {}, []
    while left:
        found = {k: explained(blocks[k], done, lasso_thresh) for k in left}
        k = max(left, key=lambda k: (found[k][0] / full[k], -k))
        left.remove(k)
        chosen = list(dict.fromkeys([*(back[at[v].origin] for v in found[k][1]), *xforce]))
        predictors |= {t: chosen for t in blocks[k]}
        order.append(blocks[k][0] if len(blocks[k]) == 1 else blocks[k])
        done += [v for t in blocks[k] for v in own[names[t]]]
    return order, predictors
