"""Choice of hyperparameters and of the number of boosting rounds by held-out loss."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.functions.threads import in_parallel
from patchloom.operators.sampling import k_folds, strata, stratified_sample

#: What may be in a grid, and what may have one value only.
GRID, SINGLE = ("num_iterations", "learning_rate", "max_depth", "num_leaves", "feature_fraction", "bagging_fraction"), ("min_data_in_leaf", "max_bin")
#: Rounds of the first fits; they are doubled until early stopping sets in.
FIRST, PATIENCE = 8, 2


@dataclass
class Tuned:
    """The chosen set, its rounds and loss, and a row for each set tried."""

    params: dict
    rounds: int | None
    loss: float | None
    rows: list[dict] = field(default_factory=list)


def grid_of(hyper: dict | None, defaults: dict) -> list[dict]:
    """Every distinct combination of the values given, defaults filling in."""
    given = {k: list(v) if isinstance(v, Sequence) and not isinstance(v, str) else [v] for k, v in (hyper or {}).items()}
    if unknown := set(given) - {*GRID, *SINGLE}:
        raise ValueError(f"no hyperparameter {sorted(unknown)}")
    if bad := [k for k in given if not given[k] or k in SINGLE and len(given[k]) > 1]:
        raise ValueError(f"one value only, or none given: {bad}")
    names = sorted({*given, *defaults})
    out = []
    for values in product(*(given.get(n, [defaults.get(n)]) for n in names)):
        if (one := dict(zip(names, values, strict=True))) not in out:
            out.append(one)
    return out


def with_folds(df: DataFrame, y: str, id_col: str, nfolds: float, continuous: bool, tag: str, name: str = "_fold") -> tuple[DataFrame, list[int]]:
    """Adds a fold, balanced over ten buckets of y or its classes, and lists the folds to hold out.

    nfolds of 2 or more is a number of folds. Under 1, that share of every bucket is fold 0, which is never held out, and
    the rest is fold 1. Folds depend on the tag and the ids alone.
    """
    held = strata(df, y, 10, id_col, "_bucket") if continuous else df.withColumn("_bucket", F.col(y).cast("string"))
    if nfolds < 1:
        kept = stratified_sample(held.select(id_col, "_bucket"), "_bucket", nfolds, tag, id_col).select(id_col, F.lit(0).alias(name))
        return held.drop("_bucket").join(kept, id_col, "left").withColumn(name, F.coalesce(name, F.lit(1))), [1]
    if nfolds != int(nfolds) or nfolds < 2:
        raise ValueError("nfolds must be 2 or more, or a share below 1")
    return k_folds(held, "_bucket", int(nfolds), tag, id_col, name).drop("_bucket"), list(range(1, int(nfolds) + 1))


def early_stop(curve: Sequence[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """(rounds, stopped): the first best of a loss by rounds, looking no further than `patience` rounds without a better one."""
    best = 0
    for k, loss in enumerate(curve):
        if loss < curve[best]:
            best = k
        elif k - best >= patience:
            return best + 1, True
    return best + 1, False


def tune_boosting(df: DataFrame, folds: Sequence[int], grid: Sequence[dict], fit: Callable[[DataFrame, dict, int], object], losses: Callable[[object, DataFrame], Sequence[float]], parallelism: int = 4, fold: str = "_fold") -> Tuned:
    """The set and rounds of the least loss, averaged over the folds held out.

    fit(df, params, rounds) gives a boosted model and losses(model, df) its loss after each round. Boosting can't be
    taken up again, so fits start with FIRST rounds and double them until the mean loss has not improved for PATIENCE
    rounds or params' num_iterations are reached: at most twice the work of the longest.
    """

    def curve(params: dict, rounds: int) -> list[float]:
        each = in_parallel([lambda k=k: list(losses(fit(df.where(F.col(fold) != k), params, rounds), df.where(F.col(fold) == k))) for k in folds], parallelism)
        return [sum(c[r] for c in each) / len(each) for r in range(min(map(len, each)))]

    def search(params: dict) -> dict:
        cap = int(params["num_iterations"])
        rounds = min(FIRST, cap)
        while True:
            found = curve(params, rounds)
            best, stopped = early_stop(found)
            if stopped or rounds >= cap:
                return {**params, "rounds": best, "loss": float(found[best - 1])}
            rounds = min(2 * rounds, cap)

    rows = [search(p) for p in grid]
    best = min(range(len(rows)), key=lambda k: rows[k]["loss"])
    return Tuned(grid[best], rows[best]["rounds"], rows[best]["loss"], [{**r, "chosen": k == best} for k, r in enumerate(rows)])


def tune_by_loss(df: DataFrame, folds: Sequence[int], grid: Sequence[dict], loss: Callable[[DataFrame, DataFrame, dict], float], parallelism: int = 4, fold: str = "_fold") -> Tuned:
    """The set of the least loss(training rows, held-out rows, params), averaged over the folds held out."""
    tasks = [lambda p=p, k=k: float(loss(df.where(F.col(fold) != k), df.where(F.col(fold) == k), p)) for p in grid for k in folds]
    found = in_parallel(tasks, parallelism)
    means = [sum(found[n * len(folds) : (n + 1) * len(folds)]) / len(folds) for n in range(len(grid))]
    best = min(range(len(grid)), key=means.__getitem__)
    return Tuned(grid[best], None, means[best], [{**p, "rounds": None, "loss": m, "chosen": k == best} for k, (p, m) in enumerate(zip(grid, means, strict=True))])
