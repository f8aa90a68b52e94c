"""Nearest centers and nearest donors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Centers that are sent to every task; a larger table of centers is an error.
MAX_CENTERS = 10_000
#: Distances that a task computes at once.
BLOCK = 1 << 20
#: Donors whose distances bound the k-th nearest beforehand, where centers * k is over this number too.
SAMPLE = 50_000


def collect_centers(centers: DataFrame, cid: str, features: Sequence[str]) -> pd.DataFrame:
    pdf = centers.select(cid, *features).orderBy(cid).limit(MAX_CENTERS + 1).toPandas()
    if len(pdf) > MAX_CENTERS:
        raise ValueError(f"more than {MAX_CENTERS} centers")
    return pdf


def nearest_center(df: DataFrame, centers: DataFrame, cid: str, features: Sequence[str]) -> DataFrame:
    """Adds cid and dist2 of the center at the least squared distance, ties to the lesser cid; rows with a null feature get nulls.

    The few centers are a broadcast matrix; only the features go to Python, a bounded block of distances at a time.
    """
    pdf = collect_centers(centers, cid, features)
    if not len(pdf):
        return df.withColumns({cid: F.lit(None).cast(centers.schema[cid].dataType), "dist2": F.lit(None).cast("double")})
    held = df.sparkSession.sparkContext.broadcast((pdf[cid].to_numpy(), pdf[list(features)].to_numpy(float)))

    def find(*columns: pd.Series) -> pd.DataFrame:
        names, c = held.value
        x = np.column_stack([v.to_numpy(float) for v in columns])
        at, least, step = np.zeros(len(x), np.int64), np.zeros(len(x)), max(1, BLOCK // len(c))
        for lo in range(0, len(x), step):
            d2 = _distances(x[lo : lo + step], c)
            at[lo : lo + step] = d2.argmin(axis=1)
            least[lo : lo + step] = d2[np.arange(len(d2)), at[lo : lo + step]]
        return pd.DataFrame({"cid": names[at], "dist2": least})

    nearest = F.pandas_udf(find, f"cid {centers.schema[cid].dataType.simpleString()}, dist2 double")(*[F.col(f).cast("double") for f in features])
    whole = F.greatest(*[F.col(f).isNull().cast("int") for f in features], F.lit(0)) == 0
    return df.withColumn("_best", F.when(whole, nearest)).withColumns({cid: F.col("_best.cid"), "dist2": F.col("_best.dist2")}).drop("_best")


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centers."""
    out = np.zeros((len(x), len(c)))
    for j in range(c.shape[1]):
        gap = x[:, [j]] - c[:, j]
        out += gap * gap
    return out


def _nearest_rows(donors: DataFrame, pdf: pd.DataFrame, k: int, cid: str, donor_id: str, features: Sequence[str], carry: Sequence[str], types: str) -> DataFrame:
    """(cid, donor_id, dist2, carry...): of every task's donors those that may be among the k nearest of a center, at most k a center and task."""
    c = pdf[list(features)].to_numpy(float)
    whole = donors.select(donor_id, *features, *carry).dropna(subset=[donor_id, *features])
    limit = np.full(len(c), np.inf)
    if len(c) * k > SAMPLE:
        n = whole.count()
        some = whole.select(*[F.col(f).cast("double") for f in features]).sample(min(1.0, SAMPLE / max(1, n)), seed=1).limit(2 * SAMPLE).toPandas().to_numpy(float)
        if len(some) >= k:
            limit = np.array([np.partition(_distances(some, c[[m]])[:, 0], k - 1)[k - 1] for m in range(len(c))])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list = [None] * len(c)
        for b in batches:
            x, ids, more = b[list(features)].to_numpy(float), b[donor_id].to_numpy(), b[list(carry)].to_numpy(float) if carry else np.zeros((len(b), 0))
            step = max(1, BLOCK // max(1, len(x)))
            for lo in range(0, len(c), step):
                for m, d2 in enumerate(np.ascontiguousarray(_distances(x, c[lo : lo + step]).T), lo):
                    old = kept[m] or (d2[:0], ids[:0], more[:0])
                    near = np.flatnonzero(~(d2 > (old[0][-1] if len(old[0]) == k else limit[m])))
                    if len(near):
                        both = np.concatenate((old[0], d2[near])), np.concatenate((old[1], ids[near])), np.concatenate((old[2], more[near]))
                        pick = np.flatnonzero(both[0] <= np.partition(both[0], k - 1)[k - 1]) if len(both[0]) > k else np.arange(len(both[0]))
                        pick = pick[np.lexsort((both[1][pick], both[0][pick]))][:k]
                        kept[m] = tuple(v[pick] for v in both)
        for lo in range(0, len(c), 64):
            some = [(n, *x) for n, x in zip(pdf[cid].to_numpy()[lo : lo + 64], kept[lo : lo + 64], strict=True) if x is not None]
            if some:
                held = {cid: np.repeat([x[0] for x in some], [len(x[1]) for x in some]), donor_id: np.concatenate([x[2] for x in some]), "dist2": np.concatenate([x[1] for x in some])}
                values = np.concatenate([x[3] for x in some])
                yield pd.DataFrame(held | {v: values[:, j] for j, v in enumerate(carry)})

    return whole.mapInPandas(partial, types + "".join(f", `{v}` double" for v in carry))


def _types(donors: DataFrame, centers: DataFrame, cid: str, donor_id: str) -> str:
    return f"{cid} {centers.schema[cid].dataType.simpleString()}, {donor_id} {donors.schema[donor_id].dataType.simpleString()}, dist2 double"


def top_k_donors(donors: DataFrame, centers: DataFrame, k: int, cid: str, donor_id: str, features: Sequence[str]) -> DataFrame:
    """(cid, donor_id, dist2, rank): the k nearest donors of each center, ties to the lesser id.

    Every task keeps its own k best for each center before anything moves, so the shuffle carries
    tasks * centers * k rows at most, and the final ranking sees only those. With many centers,
    donors farther than the k-th nearest of a sample of them stay behind too: no result needs them.
    """
    near = _nearest_rows(donors, collect_centers(centers, cid, features), k, cid, donor_id, features, (), _types(donors, centers, cid, donor_id))
    rank = F.row_number().over(Window.partitionBy(cid).orderBy("dist2", donor_id))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def donor_pools(donors: DataFrame, centers: DataFrame, k: int, cid: str, donor_id: str, features: Sequence[str], carry: Sequence[str], fit: tuple | None = None) -> DataFrame:
    """(cid, donor_id, rank, carry...): the nearest donors of each center with columns of theirs as doubles, k of them or as many as fit best.

    fit is (value column, weight column, columns of the centers' expectations: the mean and the quantiles, taus, least k);
    best_k then sets each pool's size. A center's candidates, tasks * k at most, are merged and judged in one call, so the
    donors' values travel with them and nothing is joined.
    """
    wanted = [*features, *(c for c in (fit[2] if fit else []) if c not in features)]
    pdf = collect_centers(centers, cid, wanted)
    targets = dict(zip(pdf[cid].tolist(), pdf[list(fit[2])].to_numpy(float), strict=True)) if fit else {}
    held = donors.sparkSession.sparkContext.broadcast(targets)
    near = _nearest_rows(donors, pdf, k, cid, donor_id, features, carry, _types(donors, centers, cid, donor_id))

    def merged(t: pd.DataFrame) -> pd.DataFrame:
        t = t.iloc[np.lexsort((t[donor_id].to_numpy(), t["dist2"].to_numpy()))[:k]]
        if fit:
            value, weight, _, taus, least = fit
            goal = held.value[t[cid].iloc[0]]
            t = t.iloc[: best_k(t[value].to_numpy(), t[weight].to_numpy(), goal[0], goal[1:], taus, least)]
        return t.assign(rank=np.arange(1, len(t) + 1, dtype=np.int32))[[cid, donor_id, "rank", *carry]]

    types = f"{cid} {centers.schema[cid].dataType.simpleString()}, {donor_id} {donors.schema[donor_id].dataType.simpleString()}, rank int" + "".join(f", `{v}` double" for v in carry)
    return near.groupBy(cid).applyInPandas(merged, types)


def best_k(value: np.ndarray, weight: np.ndarray, mean: float, quantiles: Sequence[float], taus: Sequence[float], at_least: int = 10) -> int:
    """How many of a center's neighbours, in order of distance, fit its expectations best: as optimal_k, for one center.

    The error of k of them is the misfit of their weighted mean, in standard deviations as the outer quantiles give
    them, plus the misfits of their shares up to each quantile; errors are averaged over five k, and the least k within
    tolerance of the least error is taken.
    """
    total = np.cumsum(weight)
    normal = NormalDist()
    sd = abs(quantiles[-1] - quantiles[0]) / (normal.inv_cdf(taus[-1]) - normal.inv_cdf(taus[0]))
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.nan_to_num((np.cumsum(value * weight) / total - mean) / sd, nan=0.0, posinf=np.inf, neginf=-np.inf)
        err = 1 - np.exp(-z * z / 2)
        for q, tau in zip(quantiles, taus, strict=True):
            err = err + np.abs(np.cumsum((value <= q) * weight) / total - tau) / max(tau, 1 - tau)
    delta = 0
    if len(err) > 5:
        err = np.convolve(err, np.full(5, 0.2), "valid")
        err[: max(0, at_least - 5)] = np.inf
        delta = 4
    if not np.isfinite(err).any():
        return len(value)
    least = np.nanmin(err)
    return int(np.flatnonzero((err <= max(least, 0.01)) | (err <= max(least * 1.05, least + 0.005)))[0]) + delta + 1


def seeded_centers(points: DataFrame, features: Sequence[str], n: int) -> np.ndarray:
    """n of the distinct points: at even quantiles of the distance from the medians, one of each distance, then, where distances repeat, those of the least hashes."""
    at = points.agg(*[F.percentile_approx(f, 0.5, 100000).alias(f) for f in features]).collect()[0]
    far = points.select(*features, F.sqrt(sum(F.pow(F.col(f) - at[f], F.lit(2)) for f in features)).alias("_far"))
    cuts = far.approxQuantile("_far", [k / max(1, n - 1) for k in range(n)], 0.5 / n)
    some = far.join(F.broadcast(points.sparkSession.createDataFrame([(c,) for c in sorted(set(cuts))], "_far double")), "_far")
    found = dict.fromkeys(sorted(tuple(r.p) for r in some.groupBy("_far").agg(F.min(F.struct(*features)).alias("p")).collect()))  # at most n rows
    if len(found) < n:
        found |= dict.fromkeys(tuple(r) for r in points.select(*features).orderBy(F.xxhash64(*features), *features).limit(2 * n).collect())
    return np.array(sorted(list(found)[:n]), float).reshape(-1, len(features))


def lloyd(points: DataFrame, features: Sequence[str], weight: str, centers: np.ndarray, rounds: int = 30, tolerance: float = 1e-3) -> np.ndarray:
    """k-means from given centers: weighted means of each center's points, until none moves by more than the tolerance.

    A task adds up its own points by center, so rounds move tasks * centers rows of sums. A center without points stays.
    """
    names = list(features)

    def sums(batches: Iterator[pd.DataFrame], c: np.ndarray) -> Iterator[pd.DataFrame]:
        total, size = np.zeros((len(c), len(names) + 1)), (c * c).sum(1)
        for b in batches:
            x, w = b[names].to_numpy(float), b[weight].to_numpy(float)
            step = max(1, BLOCK // len(c))
            for lo in range(0, len(x), step):
                near = (size - 2 * (x[lo : lo + step] @ c.T)).argmin(1)  # the distances but for what all centers share
                for j in range(len(names)):
                    total[:, j] += np.bincount(near, x[lo : lo + step, j] * w[lo : lo + step], len(c))
                total[:, -1] += np.bincount(near, w[lo : lo + step], len(c))
        some = np.flatnonzero(total[:, -1])
        yield pd.DataFrame({"k": some.astype(np.int32)} | {f"s{j}": total[some, j] for j in range(len(names) + 1)})

    types = "k int, " + ", ".join(f"s{j} double" for j in range(len(names) + 1))
    held = points.select(*[F.col(f).cast("double") for f in names], F.col(weight).cast("double").alias(weight))
    for _ in range(rounds):
        own = held.mapInPandas(lambda batches, c=centers: sums(batches, c), types).groupBy("k").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(len(names) + 1)]).collect()  # a row a center
        new = centers.copy()
        for r in own:
            new[r.k] = np.round(np.array(r[1:-1]) / r[-1], 12)  # so the order of summing leaves no trace
        moved = np.abs(new - centers).max()
        centers = new
        if moved <= tolerance:
            break
    return centers


def optimal_k(neighbors: DataFrame, cid: str, value: str, weight: str, target_mean: str, q_low: str, q_high: str, taus: tuple[float, float] = (0.25, 0.75), at_least: int = 10) -> DataFrame:
    """(cid, k, err): for each center the least number of neighbours whose weighted mean and quantile shares fit the expectations.

    neighbors holds rank, value, weight and the center's expectations. The error of k neighbours is
    the mean's misfit plus the shares' misfits, averaged over five ranks; the first k within
    tolerance of the best is taken.
    """
    span = NormalDist().inv_cdf(taus[1]) - NormalDist().inv_cdf(taus[0])
    upto = Window.partitionBy(cid).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    w = F.sum(weight).over(upto)
    mean = F.sum(F.col(value) * F.col(weight)).over(upto) / w
    sd = F.abs(F.col(q_high) - F.col(q_low)) / span
    z = F.try_divide(mean - F.col(target_mean), sd)
    err = 1 - F.exp(-z * z / 2)
    for tau, q in zip(taus, (q_low, q_high), strict=True):
        share = F.sum((F.col(value) <= F.col(q)).cast("double") * F.col(weight)).over(upto) / w
        err = err + F.abs(share - tau) / max(tau, 1 - tau)
    step = neighbors.withColumn("_raw", err)
    trail = Window.partitionBy(cid).orderBy("rank").rowsBetween(-4, 0)
    step = step.withColumn("_err", F.avg("_raw").over(trail)).where((F.col("rank") >= max(5, at_least)) & F.col("_err").isNotNull())
    best = F.min("_err").over(Window.partitionBy(cid))
    fits = (F.col("_err") <= F.greatest(best, F.lit(0.01))) | (F.col("_err") <= F.greatest(1.05 * best, best + 0.005))
    return step.withColumn("_fits", fits).where("_fits").groupBy(cid).agg(F.min("rank").alias("k"), F.min(F.struct("rank", "_err")).getField("_err").alias("err"))
