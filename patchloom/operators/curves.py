"""Conditional quantiles of y along x: bins cut by a regression tree at three offsets, and a penalised spline through their quantiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.operators.smooth import in_order, met
from patchloom.sources.scratch import stored

#: Cells of equal row counts that a group's x is cut into for the tree, and points of a default output grid, at most.
MOST_CELLS, MOST_POINTS = 30_000, 200
#: Share of a group's squared deviations that a leaf must save, deviations from the median that y is held to, offsets of the bins, knots.
COMPLEXITY, FAR, OFFSETS, KNOTS = 0.001, 3.5, (0.0, 0.5, -0.5), 10
#: Median absolute deviations are scaled to standard deviations of a normal y (fixed value).
MAD_SCALE = 1.4826


def tree_ends(n: np.ndarray, total: np.ndarray, squares: np.ndarray, least: int, complexity: float = COMPLEXITY) -> list[int]:
    """The last cells of the leaves of a least-squares regression tree over cells in order of x, given each cell's rows, sum and sum of squares.

    Leaves hold `least` rows or more, and the tree is the one of least squares plus `complexity` times the root's
    squares for each leaf. The first of equal splits is taken.
    """
    c_n, c_s, c_q = (np.concatenate([[0.0], np.cumsum(v, dtype=float)]) for v in (n, total, squares))

    def risk(a: int, b: int) -> float:
        rows, own = c_n[b] - c_n[a], c_s[b] - c_s[a]
        return max(0.0, c_q[b] - c_q[a] - own * own / rows)

    price = complexity * risk(0, len(n))
    nodes, todo = [], [(0, len(n), -1)]
    while todo:  # parents come before their children
        a, b, parent = todo.pop()
        own = len(nodes)
        nodes.append([a, b, parent, risk(a, b), []])
        if parent >= 0:
            nodes[parent][4].append(own)
        if c_n[b] - c_n[a] < 2 * least or nodes[own][3] <= price:
            continue
        cut = np.arange(a + 1, b)
        left, right = c_n[cut] - c_n[a], c_n[b] - c_n[cut]
        fits = (left >= least) & (right >= least)
        if not fits.any():
            continue
        cut, left, right = cut[fits], left[fits], right[fits]
        saved = (c_s[cut] - c_s[a]) ** 2 / left + (c_s[b] - c_s[cut]) ** 2 / right
        best = int(cut[int(np.argmax(saved))])
        if nodes[own][3] - risk(a, best) - risk(best, b) > 0:
            todo += [(best, b, own), (a, best, own)]
    cost, split = np.zeros(len(nodes)), np.zeros(len(nodes), bool)
    for k in range(len(nodes) - 1, -1, -1):
        children = nodes[k][4]
        under = sum(cost[c] for c in children)
        split[k] = bool(children) and under < nodes[k][3] + price
        cost[k] = under if split[k] else nodes[k][3] + price
    ends, todo = [], [0]
    while todo:
        k = todo.pop()
        if split[k]:
            todo += nodes[k][4]
        else:
            ends.append(nodes[k][1] - 1)
    return sorted(ends)


def shifted_bins(n: np.ndarray, ends: Sequence[int]) -> np.ndarray:
    """(offsets, cells): the bin of every cell when the leaves' bounds are moved by 0, half and minus half of the leaf that follows each, counted in rows."""
    upto = np.cumsum(n)
    stops = np.array([1, *upto[list(ends)]], float)
    width, starts = np.diff(stops), stops[:-1]
    out = np.empty((len(OFFSETS), len(n)), np.int32)
    for k, share in enumerate(OFFSETS):
        places = np.maximum(1, np.round(share * width + starts))
        at = np.unique(np.searchsorted(upto, np.concatenate([places, stops[-1:], stops[:1] if share > 0 else []])))
        out[k] = np.maximum(1, np.searchsorted(at, np.arange(len(n))))  # a bound closes the bin before it; the first one opens
    return out


def weighted_median(values: np.ndarray, rows: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    v, c = values[order], np.cumsum(rows[order])
    pick = lambda place: v[np.searchsorted(c, place)]
    return float(pick((c[-1] + 1) // 2) + pick(c[-1] // 2 + 1)) / 2


def grid(x: np.ndarray, rows: np.ndarray, ends: tuple[float, float] | None) -> list[float]:
    """Even points a tenth of x's median absolute deviation apart, MOST_POINTS at most, from the least x to the greatest or between given ends."""
    lo, hi = ends or (float(x[0]), float(x[-1]))
    inside = (x >= lo) & (x <= hi)
    step = 0.0
    if inside.any():
        middle = weighted_median(x[inside], rows[inside])
        step = 0.1 * weighted_median(np.abs(x[inside] - middle), rows[inside])
    wanted = (hi - lo) / step if step > 0 else float(MOST_POINTS)
    return [float(v) for v in np.linspace(lo, hi, max(1 if hi == lo else 2, int(np.ceil(min(wanted, MOST_POINTS)))))]


def spline(m: np.ndarray, q: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The weighted natural cubic spline of q on m read at `at`, its bend penalised by the strength of least generalised cross-validation.

    Knots are up to KNOTS quantiles of the distinct m; beyond the ends it goes on straight. One distinct m gives the mean, two a line.
    """
    lo, span = m.min(), m.max() - m.min()
    mean = float(np.average(q, weights=w))
    if span == 0:
        return np.full(len(at), mean)
    distinct = np.unique(np.round((m - lo) / span, 9))  # means of the same rows may differ in their last digits
    knots = np.quantile(distinct, np.linspace(0, 1, min(KNOTS, len(distinct))))
    k = len(knots)
    bend = np.zeros((k, k))
    second = np.zeros((k, k))  # second derivatives at the knots from values there
    if k > 2:
        h = np.diff(knots)
        d, b = np.zeros((k - 2, k)), np.zeros((k - 2, k - 2))
        for i in range(k - 2):
            d[i, i], d[i, i + 1], d[i, i + 2] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
            b[i, i] = (h[i] + h[i + 1]) / 3
            if i + 1 < k - 2:
                b[i, i + 1] = b[i + 1, i] = h[i + 1] / 6
        second[1:-1] = np.linalg.solve(b, d)
        bend = d.T @ np.linalg.solve(b, d)

    def basis(x: np.ndarray) -> np.ndarray:
        t = np.clip(x, 0, 1)
        j = np.clip(np.searchsorted(knots, t, side="right") - 1, 0, k - 2)
        h = knots[j + 1] - knots[j]
        up, down = knots[j + 1] - t, t - knots[j]
        one = np.eye(k)
        rows = (up / h)[:, None] * one[j] + (down / h)[:, None] * one[j + 1]
        rows += ((up**3 / h - h * up) / 6)[:, None] * second[j] + ((down**3 / h - h * down) / 6)[:, None] * second[j + 1]
        h0, h1 = knots[1] - knots[0], knots[-1] - knots[-2]
        left = (one[1] - one[0]) / h0 - h0 / 6 * second[1]
        right = (one[-1] - one[-2]) / h1 + h1 / 6 * second[-2]
        return rows + np.minimum(x, 0)[:, None] * left + np.maximum(x - 1, 0)[:, None] * right

    held = basis((m - lo) / span)
    w = w / w.sum() * len(m)
    gram, moment = held.T @ (w[:, None] * held), held.T @ (w * (q - mean))
    best, chosen = np.inf, None
    strengths = np.logspace(-8, 4, 49) * np.trace(gram) / max(np.trace(bend), 1e-300) if k > 2 else [0.0]
    for s in strengths:
        inverse = np.linalg.pinv(gram + s * bend, hermitian=True)
        beta = inverse @ moment
        free = len(m) - np.trace(inverse @ gram)
        score = len(m) * float((w * (q - mean - held @ beta) ** 2).sum()) / free**2 if free > 1e-6 else np.inf
        if chosen is None or score < best:
            best, chosen = score, beta
    return mean + basis((at - lo) / span) @ chosen


def _cells_to_bins(power: float, ends: tuple[float, float] | None, keys: Sequence[str]):
    def work(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("_cell", kind="stable")
        n = cells["_n"].to_numpy(np.int64)
        rows = int(n.sum())
        least = max(5, int(np.ceil(round(rows**power, 9))))
        if rows < 2 or len(cells) < 2:
            bins = np.ones((len(OFFSETS), len(cells)), np.int32)
        else:
            bins = shifted_bins(n, tree_ends(n, cells["_s"].to_numpy(float), cells["_q"].to_numpy(float), least))
        x = np.array(cells["_mx"], float)
        x[0], x[-1] = cells["_lo"].iloc[0], cells["_hi"].iloc[-1]
        points = grid(x, n, ends)
        out = cells[[*keys, "_cell"]].copy()
        out["_bins"] = list(bins.T)
        out["_least"] = least
        out["_at"] = [points if i == 0 else None for i in range(len(cells))]
        return out

    return work


def _binned_to_curve(keys: Sequence[str], quantiles: Sequence[float], mad: bool, xout: list[float] | None):
    def work(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values(["_window", "_bin"], kind="stable")
        m, w, q = bins["_m"].to_numpy(float), bins["_k"].to_numpy(float), np.array(bins["_v"].tolist(), float)
        at = np.array(xout if xout is not None else list(bins["_at"].iloc[0]), float)
        lo, hi = float(bins["_lo"].iloc[0]), float(bins["_hi"].iloc[0])
        least, most = m.min(), m.max()
        near = 1e-9 * (hi - lo)  # bins of the same rows in other windows, whose sums were added in another order
        m = np.where(m <= least + near, lo, np.where(m >= most - near, hi, m))
        if mad:
            q = np.c_[q[:, 1] - q[:, 0], q[:, 1], q[:, 2] - q[:, 1]]
        y = np.stack([spline(m, q[:, j], w, at) for j in range(q.shape[1])], axis=1)
        y = y if mad else np.sort(y, axis=1)
        out = pd.DataFrame({"x": np.tile(at, len(quantiles)), "y": y.T.ravel(), "q": np.repeat(quantiles, len(at))})
        for k in keys:
            out.insert(0, k, bins[k].iloc[0])
        return out[[*keys, "x", "y", "q"]]

    return work


def _fields(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def smooth_quantiles(df: DataFrame, x: str, y: str, quantiles: float | Sequence[float] | str = 0.5, groups: Sequence[str] = (), xout: Sequence[float] | None = None, a: float = 0.3) -> DataFrame:
    """(groups, x, y, q): smooth quantiles of y along x in each group, at even points or at xout (two numbers: even points between them).

    A regression tree of y on x, y held to 3.5 median absolute deviations, cuts x into bins of max(5, n^a) rows or more;
    they are taken as they are and moved by half a bin either way, and a penalised spline over the bins' mean x goes
    through their quantiles, weighted by rows. Curves of several quantiles don't cross. "mad" gives the quartiles'
    distances from the median for q 0.25 and 0.75, and the median for 0.5. A too low y is held to minus the upper bound.

    Rows with a null or NaN x or y play no part; a group without rows has none here; one without a bin of enough rows
    is taken as one bin. A group's x meets its tree as at most MOST_CELLS cells, from aggregates of all rows: up to
    that many rows the tree is exact. Quantiles come from running counts of distinct y in ranges of bins, so no bin
    or group is held in one task; only cells and bins are.
    """
    mad = quantiles == "mad"
    taus = [0.25, 0.5, 0.75] if mad else sorted({float(t) for t in ([quantiles] if isinstance(quantiles, int | float) else quantiles)})
    if not taus or not all(0 < t < 1 for t in taus) or a <= 0:
        raise ValueError("quantiles must lie between 0 and 1, and a above 0")
    if xout is not None and len(xout) < 2:
        raise ValueError("xout needs two numbers or more")
    keys = list(groups)
    if {"x", "y", "q"} & set(keys):
        raise ValueError("groups must not be named x, y or q")
    ends = (float(min(xout)), float(max(xout))) if xout is not None and len(xout) == 2 else None
    fixed = [float(v) for v in xout] if xout is not None and len(xout) > 2 else None

    at, value = F.col(x).cast("double"), F.col(y).cast("double")
    pairs = df.select(*keys, at.alias("_x"), value.alias("_y")).where("_x is not null and _y is not null and not isnan(_x) and not isnan(_y)")
    pairs = stored(pairs.groupBy(*keys, "_x", "_y").agg(F.count("*").alias("_k")), "pairs")

    # the bounds of y, its cells along x, and their bins
    facts = middles(pairs, keys, F.col("_y"), "_median")
    gap = met(pairs, facts, keys).withColumn("_y", F.abs(F.col("_y") - F.col("_median"))).groupBy(*keys, "_y").agg(F.sum("_k").alias("_k"))
    facts = stored(met(facts, middles(gap, keys, F.col("_y"), "_mad"), keys), "bounds")
    scale = F.col("_mad") * MAD_SCALE
    z = F.try_divide(F.col("_y") - F.col("_median"), scale)
    z = F.when(scale > 0, z).otherwise(F.when(F.col("_y") > F.col("_median"), 9e9).when(F.col("_y") < F.col("_median"), -9e9).otherwise(0.0))
    top = FAR * scale + F.col("_median")
    held = F.when(z > FAR, top).when(z < -FAR, -top).otherwise(F.col("_y")) - F.col("_median")
    points = met(pairs, facts, keys).groupBy(*keys, "_x").agg(F.sum("_k").alias("_k"), F.sum(F.col("_k") * held).alias("_s"), F.sum(F.col("_k") * held * held).alias("_q"))
    points = points.withColumn("_kd", F.col("_k").cast("double"))
    ordered = stored(in_order(points, keys, "_x", ["_kd"]), "ordered")
    sizes = ordered.groupBy(*keys).agg(F.max("_c__kd").alias("_rows"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    sizes = stored(sizes, "sizes")
    cell = F.when(F.col("_n") <= MOST_CELLS, F.col("_r")).otherwise(F.ceil(F.col("_c__kd") * MOST_CELLS / F.col("_rows"))).cast("long")
    celled = stored(met(ordered, sizes.drop("_lo", "_hi"), keys).withColumn("_cell", cell).select(*keys, "_x", "_cell", "_k", "_s", "_q"), "celled")
    cells = celled.groupBy(*keys, "_cell").agg(F.sum("_k").alias("_n"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"), (F.sum(F.col("_k") * F.col("_x")) / F.sum("_k")).alias("_mx"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    bins = cells.groupBy(*keys).applyInPandas(_cells_to_bins(a, ends, keys), f"{_fields(df, keys)}_cell long, _bins array<int>, _least int, _at array<double>")
    bins = stored(bins, "bins")

    # the bins' rows and quantiles: running counts of distinct y
    where = stored(met(celled.select(*keys, "_x", "_cell"), bins.select(*keys, "_cell", "_bins"), [*keys, "_cell"]).select(*keys, "_x", "_bins"), "binned")
    rows = met(pairs, where, [*keys, "_x"]).select(*keys, "_x", "_y", "_k", F.posexplode("_bins").alias("_window", "_bin"))
    counts = rows.groupBy(*keys, "_window", "_bin", "_y").agg(F.sum("_k").cast("double").alias("_k"), F.sum(F.col("_k") * F.col("_x")).alias("_sx"))
    cols = [*keys, "_window", "_bin"]
    counts = stored(counts, "counts")
    totals = counts.groupBy(*cols).agg(F.sum("_k").alias("_t"), (F.sum("_sx") / F.sum("_k")).alias("_m"))
    spread = in_order(counts.select(*cols, "_y", "_k"), cols, "_y", ["_k"])
    upto = met(spread, totals, cols)
    place = lambda t: F.greatest(F.lit(1.0), F.ceil(F.round(F.col("_t") * t, 6)))
    got = upto.groupBy(*cols).agg(F.first("_t").alias("_k"), F.first("_m").alias("_m"), F.array(*[F.min(F.when(F.col("_c__k") >= place(t), F.col("_y"))) for t in taus]).alias("_v"))
    facts = bins.where("_at is not null").select(*keys, "_least", "_at")
    got = met(met(got, facts, keys), sizes, keys)
    enough = (F.col("_k") >= F.col("_least")) | ((F.col("_rows") < F.col("_least")) & (F.col("_window") == 0))
    schema = f"{_fields(df, keys)}x double, y double, q double"
    return got.where(enough).groupBy(*keys).applyInPandas(_binned_to_curve(keys, taus, mad, fixed), schema)


def middles(df: DataFrame, keys: Sequence[str], value, name: str) -> DataFrame:
    """(keys, name): medians of distinct values _y with counts _k in each group, halfway between the two middle rows, by running counts."""
    ordered = in_order(df.groupBy(*keys, value.alias("_y")).agg(F.sum("_k").cast("double").alias("_k")), keys, "_y", ["_k"])
    ordered = stored(ordered.select(*keys, "_y", "_c__k"), "middles")
    rows = ordered.groupBy(*keys).agg(F.max("_c__k").alias("_t"))
    at = lambda place: F.min(F.when(F.col("_c__k") >= place, F.col("_y")))
    return met(ordered, rows, keys).groupBy(*keys).agg(((at(F.floor((F.col("_t") + 1) / 2)) + at(F.floor(F.col("_t") / 2) + 1)) / 2).alias(name))
