"""Fusion: fit conditional expectations on donors, then draw donors' values for recipients."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchloom.functions.random import uniform
from patchloom.functions.stats import denormalize, normalize
from patchloom.functions.threads import in_parallel
from patchloom.operators.neighbors import MAX_CENTERS, donor_pools, lloyd, nearest_center, seeded_centers
from patchloom.operators.rank import interval
from patchloom.operators.sampling import categorical_draw, donor_draw, implicates, pool_draw
from patchloom.operators.screen import impute_screen
from patchloom.operators.tuning import Tuned, grid_of, tune_boosting, tune_by_loss, with_folds
from patchloom.sources.scratch import scratch_path, spread, stored

RESERVED = ("M",)
#: Equal-count cuts of a target for the forests' quantiles, and leaves that a forest may have.
CUTS, MOST_LEAVES = 512, 1 << 15
#: Levels that a category may have, donors that a block's pool keeps, and rounds allowed to boosting that stops early.
MOST_LEVELS, BLOCK_POOL, MOST_ROUNDS = 1000, 30, 2500
#: Rows and columns beyond which imputation screens its predictors.
SCREEN_ROWS, SCREEN_COLUMNS = 10_000, 20


def kind_of(df: DataFrame, column: str) -> str:
    t = df.schema[column].dataType
    if isinstance(t, T.StringType):
        return "category"
    return "binary" if isinstance(t, T.BooleanType) else "number"


def all_inflated(df: DataFrame, columns: Sequence[str], share: float = 0.01, ratio: float = 0.9) -> list[str]:
    """The columns whose zeros are at least 1% and whose density at 0 falls by a tenth or more without them. One pass counts all columns' zeros, two more look at those that have enough."""
    x = {c: F.col(c).cast("double") for c in columns}
    some = lambda of, cs: df.agg(*[of(x[c]).alias(f"_{k}") for k, c in enumerate(cs)]).collect()[0] if cs else []
    zeros = some(lambda v: F.struct(F.count(v).alias("n"), F.sum((v == 0).cast("int")).alias("z")), columns)
    rows = {c: a.n for c, a in zip(columns, zeros, strict=True) if a.n and share * a.n <= a.z < a.n}
    widths = {}
    for (c, n), a in zip(rows.items(), some(lambda v: F.struct(F.stddev_samp(v).alias("sd"), F.percentile_approx(v, [0.25, 0.75]).alias("q")), list(rows)), strict=True):
        iqr = (a.q[1] - a.q[0]) / 1.34
        widths[c] = 0.9 * (min(a.sd, iqr) if iqr > 0 else a.sd) * n**-0.2
    near = {c: F.exp(-(x[c] / h) * (x[c] / h) / 2) for c, h in widths.items()}
    found = df.agg(*[F.struct(F.avg(v).alias("all"), F.avg(F.when(x[c] != 0, v)).alias("rest")).alias(f"_{k}") for k, (c, v) in enumerate(near.items())]).collect()[0] if near else []
    return [c for c, d in zip(near, found, strict=True) if d.rest / d.all < ratio]


def zero_inflated(df: DataFrame, column: str, share: float = 0.01, ratio: float = 0.9) -> bool:
    """Whether zeros are at least 1% and the density at 0 falls by a tenth or more without them."""
    return bool(all_inflated(df, [column], share, ratio))


@dataclass
class Step:
    """A target, or a block of targets that are drawn together, and what was fitted for it."""

    targets: list[str]
    predictors: list[str]
    kind: str
    levels: list = field(default_factory=list)
    features: PipelineModel | None = None
    zero: object = None
    models: dict = field(default_factory=dict)
    scales: dict = field(default_factory=dict)
    centers: DataFrame | None = None
    donors: DataFrame | None = None
    r2: float | None = None
    tuning: list = field(default_factory=list)


def _features(df: DataFrame, predictors: Sequence[str]) -> PipelineModel:
    """Assembles predictors: strings by index (unseen ones apart), booleans and numbers as they are; nulls are 0 with a flag."""
    texts = [p for p in predictors if kind_of(df, p) == "category"]
    stages = [StringIndexer(inputCol=p, outputCol=f"_i_{p}", handleInvalid="keep", stringOrderType="alphabetAsc") for p in texts]
    inputs = [f"_i_{p}" if p in texts else f"_n_{p}" for p in predictors] + [f"_m_{p}" for p in predictors if p not in texts]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="_x")]).fit(_numbers(df, predictors))


def _numbers(df: DataFrame, predictors: Sequence[str]) -> DataFrame:
    plain = [p for p in predictors if kind_of(df, p) != "category"]
    return df.withColumns({f"_n_{p}": F.coalesce(F.col(p).cast("double"), F.lit(0.0)) for p in plain} | {f"_m_{p}": F.col(p).isNull().cast("double") for p in plain})


def _featured(df: DataFrame, step: Step) -> DataFrame:
    out = step.features.transform(_numbers(df, step.predictors))
    return out.select(*df.columns, "_x")


class QuantileForest:
    """Quantiles by regression forest: each tree's leaf has the weighted quantile of its donors, and trees are averaged."""

    def __init__(self, forest, leaves: DataFrame) -> None:
        self.forest, self.leaves = forest, leaves

    @classmethod
    def fit(cls, df: DataFrame, label: str, quantiles: Sequence[float], trees: int, depth: int, bins: int, seed: int, weight: str = "_w", **options) -> QuantileForest:
        """Weights of donors at equal-count cuts of the label are summed by leaf; a leaf's quantile is the largest value of the cut where it is reached."""
        if trees << depth > MOST_LEAVES:
            raise ValueError(f"trees * 2^depth must not pass {MOST_LEAVES}")
        forest = RandomForestRegressor(featuresCol="_x", labelCol=label, weightCol=weight, numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed, leafCol="_leaf", **options).fit(df)
        cuts = sorted(set(df.approxQuantile(label, [k / CUTS for k in range(1, CUTS)], 0.2 / CUTS)))
        own = forest.transform(df).select(F.posexplode(vector_to_array("_leaf")).alias("tree", "leaf"), F.col(label).alias("v"), F.col(weight).alias("w"))
        held = own.groupBy("tree", "leaf", interval("v", cuts).alias("cut")).agg(F.sum("w").alias("w"), F.max("v").alias("v"))  # trees x leaves x CUTS rows at most
        leaf = Window.partitionBy("tree", "leaf")
        reached = held.withColumns({"upto": F.sum("w").over(leaf.orderBy("cut")), "all": F.sum("w").over(leaf)})
        found = F.array(*[F.min(F.when(F.col("upto") >= q * F.col("all") * (1 - 1e-12), F.col("v"))) for q in quantiles])
        return cls(forest, stored(reached.groupBy("tree", "leaf").agg(found.alias("q")), "leaves"))

    def transform(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        """Adds the quantiles by look-up in the leaves' table, which the trees' depth bounds and each row carries as a literal."""
        rows = self.leaves.collect()
        table = [[None] * (1 + max(int(r.leaf) for r in rows if r.tree == t)) for t in range(1 + max(r.tree for r in rows))]
        for r in rows:
            table[r.tree][int(r.leaf)] = r.q
        known = F.from_json(F.lit(json.dumps(table)), "array<array<array<double>>>")
        found = F.transform(vector_to_array("_leaf"), lambda leaf, tree: known[tree][leaf.cast("int")])
        held = self.forest.transform(df).withColumn("_found", found)
        mean = lambda k: F.aggregate("_found", F.lit(0.0), lambda a, q: a + q[k]) / F.size("_found")
        return held.select(*df.columns, *[mean(k).alias(n) for k, n in enumerate(names)])


def pinball(y: Column, q: Column, tau: float) -> Column:
    """The loss of a quantile forecast."""
    return F.greatest(tau * (y - q), (tau - 1) * (y - q))


def ptiles(n: int) -> tuple[float, ...]:
    """The middles of n equal shares, the quantiles that n models expect."""
    return tuple((2 * k + 1) / (2 * n) for k in range(n))


def tree_use(spark: SparkSession, model) -> dict[int, tuple[int, int]]:
    """By feature: how many training rows come to the splits of a tree model that use it, and how many splits there are."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("nodeData.*").where("leftChild >= 0")
    found = nodes.groupBy(F.col("split.featureIndex").alias("feature")).agg(F.count("*").alias("n"), F.sum("rawCount").alias("rows")).collect()  # a row a feature
    return {r.feature: (r.rows, r.n) for r in found}


@dataclass
class DonorFusion:
    """Estimator of fusion models.

    y lists targets in order, a list inside it being a block drawn jointly; a target's predictors
    are x and the targets before it. Numbers are drawn from donors near in expectation (mean and
    quantiles, two or more, rising), zero-inflated ones after a model of zero; categories and booleans
    from class probabilities. Donors need a unique id_col. weight is a column of non-negative donor
    weights. nclusters of 0 makes every distinct expectation a center.

    With nfolds, hyperparameters are chosen by held-out loss: as many folds, or, under 1, that share of
    the donors to fit to. hyper maps a name of tuning.GRID to a value or a list of them, every
    combination being tried, or a name of tuning.SINGLE to a value. Boosting then stops early and is
    fitted to all donors with the rounds that were best. Without nfolds hyper has single values, and
    boosting has `iterations` rounds. Steps and models are fitted some at a time (parallelism).
    """

    y: Sequence
    x: Sequence[str]
    id_col: str
    weight: str | None = None
    quantiles: Sequence[float] = (0.25, 0.75)
    nclusters: int = 2000
    krange: tuple[int, int] = (10, 500)
    k_block: int = 10
    trees: int = 10
    depth: int = 5
    iterations: int = 10
    seed: int = 1
    nfolds: float | None = None
    hyper: dict | None = None
    kmeans_rounds: int = 10
    parallelism: int = 4

    def _check(self, df: DataFrame) -> list[list[str]]:
        steps = [[s] if isinstance(s, str) else list(s) for s in self.y]
        names = [t for s in steps for t in s]
        if not names or not self.x:
            raise ValueError("y and x must not be empty")
        if set(names) & set(self.x) or len(set(names)) < len(names) or set(names) & set(RESERVED):
            raise ValueError("targets must be distinct, not predictors and not reserved")
        if len(self.quantiles) < 2 or list(self.quantiles) != sorted(set(self.quantiles)) or not 0 < self.quantiles[0] < self.quantiles[-1] < 1:
            raise ValueError("quantiles must be two or more rising shares")
        if not 1 <= self.k_block <= BLOCK_POOL:
            raise ValueError(f"k_block must be from 1 to {BLOCK_POOL}")
        for c in [*names, *self.x, self.id_col, *[self.weight] * bool(self.weight)]:
            if c not in df.columns:
                raise ValueError(f"no column {c}")
        if self.nfolds is None and len(grid_of(self.hyper, {})) > 1:
            raise ValueError("a grid needs nfolds")
        nulls = df.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in names]).collect()[0]
        if bad := [c for c in names if nulls[c]]:
            raise ValueError(f"targets with nulls: {bad}")
        return steps

    def fit(self, df: DataFrame) -> FittedFusion:
        plan = self._check(df)
        names = [t for s in plan for t in s]
        data = spread(df.select(self.id_col, *self.x, *names, (F.col(self.weight).cast("double") if self.weight else F.lit(1.0)).alias("_w")), self.id_col, "donor")
        steps, before = [], list(self.x)
        for targets in plan:
            kinds = {kind_of(data, t) for t in targets}
            if len(targets) > 1 and kinds != {"number"}:
                raise ValueError("a block holds numbers only")
            steps.append(Step(targets, list(before), "block" if len(targets) > 1 else kinds.pop()))
            before += targets

        def train(step: Step) -> None:  # by observed values of the targets before, so no step waits for another
            step.features = _features(data, step.predictors)
            self._fit(step, _featured(data, step))

        in_parallel([lambda s=s: train(s) for s in steps], self.parallelism)
        return FittedFusion(self, steps, {c: data.schema[c].dataType.simpleString() for c in [*self.x, *names]})

    def _bins(self, df: DataFrame) -> int:
        meta = df.schema["_x"].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", [])
        return max([32, *(len(a.get("vals", [])) + 1 for a in meta)])

    def _grid(self) -> list[dict]:
        return grid_of(self.hyper, {"max_depth": self.depth, "num_iterations": self.iterations if self.nfolds is None else MOST_ROUNDS})

    def _options(self, p: dict, bins: int, boosting: bool) -> dict:
        """Arguments of Spark's tree estimators for a set of hyperparameters."""
        depth = int(p["max_depth"])
        if p.get("num_leaves"):
            depth = min(depth, int(math.log2(p["num_leaves"])))
        out = {"maxDepth": depth, "maxBins": max(bins, int(p.get("max_bin") or 0)), "seed": self.seed, "subsamplingRate": float(p.get("bagging_fraction") or 1.0), "minInstancesPerNode": int(p.get("min_data_in_leaf") or 1)}
        if p.get("feature_fraction"):
            out["featureSubsetStrategy"] = "all" if p["feature_fraction"] >= 1 else str(float(p["feature_fraction"]))
        return out | ({"stepSize": float(p.get("learning_rate") or 0.1)} if boosting else {})

    def _folds(self, data: DataFrame, tag: str, continuous: bool) -> tuple[DataFrame, list[int]]:
        """The data with one fold column for all models of a target."""
        if self.nfolds is None:
            return data, []
        folded, folds = with_folds(data, "_y", self.id_col, self.nfolds, continuous, f"fold|{tag}")
        return stored(folded, "folds"), folds

    def _boosted(self, step: Step, name: str, kind: type, data: DataFrame, folds: list[int], bins: int):
        """A boosted model of _y, of the best hyperparameters and rounds where there are folds."""

        def fit(df: DataFrame, p: dict, rounds: int):
            return kind(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=rounds, **self._options(p, bins, True)).fit(df)

        losses = (lambda m, d: m.evaluateEachIteration(d, "squared")) if kind is GBTRegressor else (lambda m, d: m.evaluateEachIteration(d))
        return self._chosen(step, name, tune_boosting(data, folds, self._grid(), fit, losses, self.parallelism) if folds else None, lambda p, rounds: fit(data, p, rounds))

    def _chosen(self, step: Step, name: str, tuned: Tuned | None, fit):
        if tuned is None:
            p = self._grid()[0]
            return fit(p, int(p["num_iterations"]))
        step.tuning += [{"model": name, **row} for row in tuned.rows]
        return fit(tuned.params, tuned.rounds)

    def _forest_grid(self) -> list[dict]:
        """The grid without what forests have no use for."""
        sets = []
        for p in self._grid():
            if (q := {k: v for k, v in p.items() if k not in ("num_iterations", "learning_rate")}) not in sets:
                sets.append(q)
        return sets

    def _quantile_forest(self, step: Step, name: str, data: DataFrame, folds: list[int], bins: int) -> QuantileForest:
        names = [f"_q{k}" for k in range(len(self.quantiles))]

        def fit(df: DataFrame, p: dict) -> QuantileForest:
            o = self._options(p, bins, False)
            return QuantileForest.fit(df, "_y", self.quantiles, self.trees, o.pop("maxDepth"), o.pop("maxBins"), o.pop("seed"), **o)

        def loss(train: DataFrame, held: DataFrame, p: dict) -> float:
            each = sum(pinball(F.col("_y"), F.col(q), tau) for q, tau in zip(names, self.quantiles, strict=True)) / len(names)
            return fit(train, p).transform(held, names).agg(F.sum(each * F.col("_w")) / F.sum("_w")).collect()[0][0]

        tuned = tune_by_loss(data, folds, self._forest_grid(), loss, self.parallelism) if folds else None
        return self._chosen(step, name, tuned, lambda p, _: fit(data, p))

    def _class_forest(self, step: Step, data: DataFrame, folds: list[int], bins: int):
        def fit(df: DataFrame, p: dict):
            return RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=self.trees, **self._options(p, bins, False)).fit(df)

        def loss(train: DataFrame, held: DataFrame, p: dict) -> float:
            own = F.greatest(F.try_element_at(vector_to_array("probability"), F.col("_y").cast("int") + 1), F.lit(1e-15))
            return fit(train, p).transform(held).agg(F.sum(-F.log(F.coalesce(own, F.lit(1e-15))) * F.col("_w")) / F.sum("_w")).collect()[0][0]

        tuned = tune_by_loss(data, folds, self._forest_grid(), loss, self.parallelism) if folds else None
        return self._chosen(step, "class", tuned, lambda p, _: fit(data, p))

    def _fit(self, step: Step, data: DataFrame) -> None:
        bins, t = self._bins(data), step.targets[0]
        tag = "+".join(step.targets)
        if step.kind == "category":
            step.levels = [r[0] for r in data.select(t).distinct().orderBy(t).limit(MOST_LEVELS + 1).collect()]
            if len(step.levels) > MOST_LEVELS:
                raise ValueError(f"{t} has more than {MOST_LEVELS} levels")
            codes = F.array_position(F.array(*[F.lit(v) for v in step.levels]), F.col(t)) - 1
            own, folds = self._folds(data.withColumn("_y", codes.cast("double")), tag, False)
            step.models["class"] = self._class_forest(step, own, folds, bins)
            return
        if step.kind == "binary":
            own, folds = self._folds(data.withColumn("_y", F.col(t).cast("double")), tag, False)
            step.models["class"] = self._boosted(step, "class", GBTClassifier, own, folds, bins)
            return
        if step.kind == "number" and zero_inflated(data, t):
            own, folds = self._folds(data.withColumn("_y", (F.col(t) == 0).cast("double")), f"zero|{tag}", False)
            step.zero = self._boosted(step, "zero", GBTClassifier, own, folds, bins)
            data = data.where(F.col(t) != 0)
        held = {c: self._folds(data.withColumn("_y", F.col(c).cast("double")), c, True) for c in step.targets}
        tasks = [lambda c=c: self._boosted(step, f"mean {c}", GBTRegressor, *held[c], bins) for c in step.targets]
        tasks += [lambda c=c: self._quantile_forest(step, f"quantile {c}", *held[c], bins) for c in step.targets]
        fitted = in_parallel(tasks, self.parallelism)
        step.models = dict(zip(step.targets, zip(fitted, fitted[len(step.targets) :], strict=False), strict=True))
        expected = stored(self.expect(step, data), "expected")
        self._pools(step, expected)

    def _pools(self, step: Step, expected: DataFrame) -> None:
        """Scales the expectations, finds centers among them, and gives each center its donors."""
        t, features = step.targets[0], self.expectations(step)
        middle = expected.agg(*[F.percentile_approx(f, 0.5, 100000).alias(f) for f in features], *[(F.min(f).between(0, 1) & F.max(f).between(0, 1)).alias(f"in_{f}") for f in features]).collect()[0]
        spread = expected.agg(*[(F.percentile_approx(F.abs(F.col(f) - middle[f]), 0.5, 100000) * 1.4826).alias(f) for f in features], *[F.stddev_samp(f).alias(f"sd_{f}") for f in features]).collect()[0]
        step.scales = {f: None if middle[f"in_{f}"] else (middle[f], spread[f] or spread[f"sd_{f}"] or 1.0) for f in features}
        scaled = stored(self.scale(step, expected), "scaled")
        found = self._centers(scaled, features)
        plain = [f"_t{k}" for k in range(len(features))]
        unscaled = [F.col(f) if step.scales[f] is None else denormalize(F.col(f), *step.scales[f]) for f in features]
        spark = expected.sparkSession
        centers = spark.createDataFrame([(k, *map(float, c)) for k, c in enumerate(found)], "cid int, " + ", ".join(f"`{f}` double" for f in features))
        step.centers = centers.select("cid", *features, *[c.alias(n) for c, n in zip(unscaled, plain, strict=True)])
        block = step.kind == "block"
        rule = None if block else (t, "_w", plain, tuple(self.quantiles), self.krange[0])
        pools = donor_pools(scaled, step.centers, BLOCK_POOL if block else self.krange[1], "cid", self.id_col, features, ["_w", *step.targets], rule)
        step.donors = stored(pools.select("cid", F.col(self.id_col).alias("donor_id"), "rank", "_w", *[F.col(c).cast(expected.schema[c].dataType).alias(c) for c in step.targets]), "neighbors")
        if not block:
            step.r2 = self._r2(step)

    @staticmethod
    def _r2(step: Step) -> float | None:
        """How much of the centers' expected means the means of their pools keep: 1 - SSR / SST."""
        own = step.donors.groupBy("cid").agg((F.sum(F.col(step.targets[0]) * F.col("_w")) / F.sum("_w")).alias("m")).join(step.centers, "cid")
        r = own.agg(F.sum(F.pow(F.col("_t0") - F.col("m"), F.lit(2))).alias("ssr"), (F.var_pop("_t0") * F.count("*")).alias("sst")).collect()[0]
        return 1 - r.ssr / r.sst if r.sst else None

    def _centers(self, scaled: DataFrame, features: list[str]) -> list:
        """Every distinct expectation if there are at most nclusters of them, else k-means from points spread over the distances from the median."""
        most = self.nclusters or MAX_CENTERS
        points = spread(scaled.groupBy(*features).agg(F.count("*").cast("double").alias("_n")), features[0], "points")
        few = points.select(*features).limit(most + 1).collect()
        if len(few) <= most:
            return sorted(tuple(r) for r in few)
        if not self.nclusters:
            raise ValueError(f"more than {MAX_CENTERS} distinct expectations: give nclusters")
        return lloyd(points, features, "_n", seeded_centers(points, features, most), self.kmeans_rounds).tolist()

    def expectations(self, step: Step) -> list[str]:
        return [f"_e{k}_{t}" for t in step.targets for k in range(1 + len(self.quantiles))]

    def expect(self, step: Step, data: DataFrame) -> DataFrame:
        """Adds the mean and the quantiles that the models expect of each target."""
        for t in step.targets:
            boost, forest = step.models[t]
            data = boost.transform(data).withColumnRenamed("prediction", f"_e0_{t}")
            data = forest.transform(data, [f"_e{k + 1}_{t}" for k in range(len(self.quantiles))])
        return data

    def scale(self, step: Step, data: DataFrame) -> DataFrame:
        """The expectations around their medians; those that are all in [0, 1] stay as they are."""
        return data.withColumns({f: normalize(F.col(f), *step.scales[f]) for f in self.expectations(step) if step.scales[f]})


@dataclass
class FittedFusion:
    spec: DonorFusion
    steps: list[Step]
    contract: dict[str, str]

    def _check(self, df: DataFrame) -> None:
        for p in self.spec.x:
            if p not in df.columns:
                raise ValueError(f"no predictor {p}")
            want, got = self.contract[p], df.schema[p].dataType.simpleString()
            if want != got and not {want, got} <= {"int", "bigint", "double", "float", "smallint"}:
                raise ValueError(f"predictor {p} is {got}, not {want}")

    def transform(self, df: DataFrame, m: int = 1, retain: Sequence[str] = (), k_block: int | None = None) -> DataFrame:
        """(M, id, retain..., targets...): m simulated versions of the targets for every row.

        Randomness is keyed by target, implicate and id, so results don't depend on partitions. k_block, if
        given, takes the place of the model's: blocks are drawn from so many nearest donors.
        """
        self._check(df)
        k_block = k_block or self.spec.k_block
        if not 1 <= k_block <= BLOCK_POOL:
            raise ValueError(f"k_block must be from 1 to {BLOCK_POOL}")
        keys = ["M", self.spec.id_col]
        held = implicates(spread(df.select(self.spec.id_col, *dict.fromkeys([*self.spec.x, *retain])), self.spec.id_col, "recipient"), m)
        for step in self.steps:
            held = stored(self._simulate(step, held, keys, k_block), "fused")
        return held.select("M", self.spec.id_col, *retain, *[t for s in self.steps for t in s.targets])

    def tuning(self) -> DataFrame:
        """(y, model, params, rounds, loss, chosen): a row for each set of hyperparameters tried, params as JSON."""
        sets = [(s, {k: v for k, v in r.items() if k not in ("model", "rounds", "loss", "chosen") and v is not None}, r) for s in self.steps for r in s.tuning]
        rows = [("+".join(s.targets), r["model"], json.dumps(p, sort_keys=True), r["rounds"], r["loss"], r["chosen"]) for s, p, r in sets]
        return SparkSession.getActiveSession().createDataFrame(rows, "y string, model string, params string, rounds int, loss double, chosen boolean")

    def _simulate(self, step: Step, held: DataFrame, keys: list[str], k_block: int) -> DataFrame:
        t, spec, plain = step.targets[0], self.spec, held.columns
        data = _featured(held, step)
        u = uniform(f"fuse|{'+'.join(step.targets)}", *keys)
        if step.kind in ("category", "binary"):
            p = vector_to_array("probability")
            out = step.models["class"].transform(data).withColumn("_p", p)
            if step.kind == "binary":
                return out.withColumn(t, F.col("_p")[1] > u).select(*plain, t)
            return out.withColumn(t, categorical_draw([F.col("_p")[k] for k in range(len(step.levels))], step.levels, u)).select(*plain, t)
        data = data.withColumn("_key", F.concat_ws("|", *keys))
        if step.zero is not None:
            zero = uniform(f"zero|{t}", *keys)
            data = step.zero.transform(data).withColumn("_zero", zero < vector_to_array("probability")[1]).select(*plain, "_x", "_key", "_zero")
        else:
            data = data.withColumn("_zero", F.lit(False))
        rest = spec.scale(step, spec.expect(step, data.where("not _zero")))
        rest = nearest_center(rest, step.centers, "cid", spec.expectations(step)).withColumn("_u", u)
        donors = step.donors.where(F.col("rank") <= k_block) if step.kind == "block" else step.donors
        none = [F.lit(0).cast(donors.schema[c].dataType).alias(c) for c in step.targets]
        full = pool_draw(rest.select(*plain, "cid", "_u"), donors, "cid", "_w", step.targets, "_u", "donor_id")
        if full is None:
            drawn = donor_draw(rest.select("_key", "cid", "_u"), donors, "cid", "_w", step.targets, F.col("_u"), "_key", "donor_id")
            full = rest.select(*plain, "_key").join(drawn.select("_key", *step.targets), "_key")
        full = full.select(*plain, *step.targets)
        return full if step.zero is None else full.unionByName(data.where("_zero").select(*plain, *none))

    def importance(self) -> tuple[DataFrame, DataFrame]:
        """(summary, detailed): the predictors' shares of gain, cover and frequency by target, and by target and model.

        Gain is what a predictor's splits take off the impurity, cover the donors that come to them, and frequency their
        number, read from the models' trees. The summary averages a target's models and makes shares of it; place is the
        order to show predictors in: targets, the last one first, then the others by their mean gain.
        """
        models = []
        for s in self.steps:
            names = list(s.predictors) + [p for p in s.predictors if f"_i_{p}" not in s.features.stages[-1].getInputCols()]
            own = [("zero", s.zero)] * (s.zero is not None)
            own += [(kind, m) for t in s.targets if t in s.models for kind, m in (("mean", s.models[t][0]), ("quantile", s.models[t][1].forest))] or [("class", s.models["class"])]
            models += [("+".join(s.targets), kind, names, m) for kind, m in own]
        spark = SparkSession.getActiveSession()
        used = in_parallel([lambda m=m: tree_use(spark, m) for *_, m in models], self.spec.parallelism)
        rows = [(y, kind, x, float(g), *map(float, splits.get(k, (0, 0)))) for (y, kind, names, m), splits in zip(models, used, strict=True) for k, (x, g) in enumerate(zip(names, m.featureImportances.toArray(), strict=False))]
        kinds = ["gain", "cover", "frequency"]
        detailed = spark.createDataFrame(rows, "y string, model string, x string, gain double, cover double, frequency double").groupBy("y", "model", "x").agg(*[F.sum(c).alias(c) for c in kinds])
        shares = lambda by: {c: F.coalesce(F.try_divide(c, F.sum(c).over(Window.partitionBy(*by))), F.lit(0.0)) for c in kinds}
        detailed = detailed.withColumns(shares(["y", "model"]))
        mean = detailed.groupBy("y", "x").agg(*[F.avg(c).alias(c) for c in kinds]).withColumns(shares(["y"]))
        targets = [t for s in self.steps for t in s.targets]
        rank = {t: k for k, t in enumerate(reversed(targets))}
        by_gain = mean.groupBy("x").agg(F.avg("gain").alias("_g")).orderBy("_g", "x").select("x").collect()  # one row a predictor
        order = sorted((r.x for r in by_gain), key=lambda x: rank.get(x, len(targets)))
        places = spark.createDataFrame([(x, k) for k, x in enumerate(order, 1)], "x string, place int")
        return mean.join(places, "x").select("y", "x", *kinds, "place"), detailed

    def save(self, path: str) -> str:
        """Writes the models, the neighbour tables and a JSON description under a folder."""
        spark = SparkSession.getActiveSession()
        described = []
        for n, s in enumerate(self.steps):
            at = f"{path}/step{n}"
            s.features.write().overwrite().save(f"{at}/features")
            if s.zero is not None:
                s.zero.write().overwrite().save(f"{at}/zero")
            for name, m in s.models.items():
                if name == "class":
                    m.write().overwrite().save(f"{at}/class")
                else:
                    m[0].write().overwrite().save(f"{at}/mean_{name}")
                    m[1].forest.write().overwrite().save(f"{at}/forest_{name}")
                    m[1].leaves.write.mode("overwrite").parquet(f"{at}/leaves_{name}")
            if s.centers is not None:
                s.centers.write.mode("overwrite").parquet(f"{at}/centers")
                s.donors.write.mode("overwrite").parquet(f"{at}/donors")
            described.append({"targets": s.targets, "predictors": s.predictors, "kind": s.kind, "levels": s.levels, "zero": s.zero is not None, "models": list(s.models), "scales": s.scales, "r2": s.r2, "tuning": s.tuning})
        spec = {k: getattr(self.spec, k) for k in ("y", "x", "id_col", "weight", "quantiles", "nclusters", "krange", "k_block", "trees", "depth", "iterations", "seed", "nfolds", "hyper", "kmeans_rounds", "parallelism")}
        text = json.dumps({"spec": spec, "steps": described, "contract": self.contract})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
        return path


def load_fusion(spark: SparkSession, path: str) -> FittedFusion:
    from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
    from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel

    meta = json.loads("".join(r.value for r in spark.read.text(f"{path}/metadata").collect()))
    steps = []
    for n, d in enumerate(meta["steps"]):
        at, s = f"{path}/step{n}", Step(d["targets"], d["predictors"], d["kind"], d["levels"], r2=d["r2"], tuning=d["tuning"])
        s.features = PipelineModel.load(f"{at}/features")
        s.scales = {k: v and tuple(v) for k, v in d["scales"].items()}
        s.zero = GBTClassificationModel.load(f"{at}/zero") if d["zero"] else None
        for name in d["models"]:
            if name == "class":
                s.models[name] = (RandomForestClassificationModel if d["kind"] == "category" else GBTClassificationModel).load(f"{at}/class")
            else:
                s.models[name] = (GBTRegressionModel.load(f"{at}/mean_{name}"), QuantileForest(RandomForestRegressionModel.load(f"{at}/forest_{name}"), spark.read.parquet(f"{at}/leaves_{name}")))
        if d["scales"]:
            s.centers, s.donors = spark.read.parquet(f"{at}/centers"), spark.read.parquet(f"{at}/donors")
        steps.append(s)
    spec = meta["spec"] | {k: tuple(meta["spec"][k]) for k in ("quantiles", "krange")}
    return FittedFusion(DonorFusion(**spec), steps, meta["contract"])


def impute_by_fusion(df: DataFrame, id_col: str, weight: str | None = None, ignore: Sequence[str] = (), screen: bool | None = None, **options) -> DataFrame:
    """Fills every column that has some nulls, fewest first, by fusion from the rows that have a value; filled columns predict later ones.

    Predictors are screened first if screen, or by default if there are more than 10,000 rows or 20 columns.
    """
    columns = [c for c in df.columns if c not in (id_col, weight, *ignore)]
    row = df.agg(F.count("*").alias("_n"), *[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in columns]).collect()[0]
    todo = sorted((c for c in columns if 0 < (row[c] or 0) < row["_n"]), key=lambda c: row[c])
    chosen = {c: [p for p in columns if p != c] for c in todo}
    if todo and (row["_n"] > SCREEN_ROWS or len(df.columns) > SCREEN_COLUMNS if screen is None else screen):
        kept = {(r.y, r.x) for r in impute_screen(df, todo, columns).collect()}  # 30 rows a target at most
        chosen = {c: [p for p in x if (c, p) in kept] for c, x in chosen.items()}
    for c in todo:
        model = DonorFusion([c], chosen[c], id_col, weight, **options).fit(df.where(F.col(c).isNotNull()))
        drawn = model.transform(df.where(F.col(c).isNull()), 1).select(id_col, F.col(c).alias("_new"))
        df = stored(df.join(drawn, id_col, "left").withColumn(c, F.coalesce(c, "_new")).drop("_new"), "imputed")
    return df
