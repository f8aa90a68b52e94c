import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.operators import sampling
from patchloom.operators.fusion import DonorFusion, load_fusion, ptiles
from patchloom.operators.neighbors import best_k, donor_pools, lloyd, optimal_k, seeded_centers, top_k_donors
from patchloom.operators.tuning import Tuned, early_stop, grid_of, tune_boosting, tune_by_loss, with_folds


def test_early_stopping():
    assert early_stop([5, 4, 3, 3.5, 3.2, 1]) == (3, True)  # what comes after two rounds without a better one isn't seen
    assert early_stop([5, 4, 3, 3.5]) == (3, False) and early_stop([1]) == (1, False)
    assert early_stop([3, 3, 3, 2]) == (1, True)  # a tie is no better
    assert early_stop([5, 4, 4.5, 3, 3.1, 3.2]) == (4, True)


def test_grid():
    assert grid_of({"max_depth": [2, 3], "learning_rate": [0.1, 0.3]}, {"num_iterations": 9}) == [{"learning_rate": r, "max_depth": d, "num_iterations": 9} for r in (0.1, 0.3) for d in (2, 3)]
    assert grid_of(None, {"max_depth": 5}) == [{"max_depth": 5}] and len(grid_of({"max_depth": [2, 2]}, {})) == 1
    for bad in ({"depth": 3}, {"max_bin": [3, 4]}, {"max_depth": []}):
        with pytest.raises(ValueError):
            grid_of(bad, {})


def test_folds(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 97).cast("double").alias("y"), (F.col("id") % 5 == 0).alias("z"))
    got, folds = with_folds(df, "y", "id", 5, True, "t")
    assert folds == [1, 2, 3, 4, 5] and sorted(r["count"] for r in got.groupBy("_fold").count().collect()) == [200] * 5
    means = [r.m for r in got.groupBy("_fold").agg(F.avg("y").alias("m")).collect()]
    assert max(means) - min(means) < 3  # balanced over y
    again = with_folds(df.repartition(7), "y", "id", 5, True, "t")[0]
    assert sorted(map(tuple, got.select("id", "_fold").collect())) == sorted(map(tuple, again.select("id", "_fold").collect()))
    got, folds = with_folds(df, "z", "id", 0.75, False, "t")
    assert folds == [1] and {(r.z, r._fold): r["count"] for r in got.groupBy("z", "_fold").count().collect()} == {(True, 0): 150, (True, 1): 50, (False, 0): 600, (False, 1): 200}
    with pytest.raises(ValueError):
        with_folds(df, "y", "id", 2.5, True, "t")


def test_the_search_takes_the_better_set_and_the_round_where_it_turns(spark):
    """Losses known beforehand: by fold and rounds, with the turn beyond the first fits."""
    df = spark.createDataFrame([(k, k % 2 + 1) for k in range(8)], "id int, _fold int")
    asked = []

    def curve(turn, level, held):
        return lambda r: level + abs(r - turn) / 10 + held / 100

    def fit(data, params, rounds):
        asked.append((params["max_depth"], rounds))
        return params, rounds

    def losses(model, data):
        params, rounds = model
        f = curve(*{2: (11, 3.0), 3: (20, 1.0), 4: (2, 2.0)}[params["max_depth"]], data.first()._fold)
        return [f(r + 1) for r in range(rounds)]

    grid = [{"max_depth": d, "num_iterations": 100} for d in (2, 3, 4)]
    got = tune_boosting(df, [1, 2], grid, fit, losses, parallelism=1)
    assert (got.params["max_depth"], got.rounds) == (3, 20) and got.loss == pytest.approx(1.015)
    assert [(r["max_depth"], r["rounds"], r["chosen"]) for r in got.rows] == [(2, 11, False), (3, 20, True), (4, 2, False)]
    assert sorted(set(asked)) == [(2, 8), (2, 16), (3, 8), (3, 16), (3, 32), (4, 8)]
    got = tune_boosting(df, [1], [{"max_depth": 3, "num_iterations": 12}], fit, losses)
    assert got.rounds == 12  # no further than allowed
    got = tune_by_loss(df, [1, 2], grid, lambda a, b, p: p["max_depth"] % 4 + b.first()._fold, parallelism=2)
    assert isinstance(got, Tuned) and got.params["max_depth"] == 4 and got.loss == 1.5


def test_tuned_fusion(spark, tmp_path):
    """y depends on a step in a and a product; deep trees and a high rate overfit the noise. Each model has its table."""
    rng = np.random.default_rng(3)
    rows = [(k, float(a), float(b), float(10 * (a > 0.5) + 3 * a * b + e), bool(a + e / 3 > 0.5)) for k, (a, b, e) in enumerate(zip(rng.random(400), rng.random(400), rng.normal(0, 1, 400), strict=True))]
    df = spark.createDataFrame(rows, "rid int, a double, b double, y double, z boolean")
    spec = DonorFusion(["z", "y"], ["a", "b"], "rid", quantiles=ptiles(3), nclusters=20, krange=(5, 40), trees=3, nfolds=2, hyper={"max_depth": [2, 6], "learning_rate": 0.3, "num_iterations": 16, "max_bin": 64})
    model = spec.fit(df)
    table = model.tuning().collect()
    assert {(r.y, r.model) for r in table} == {("z", "class"), ("y", "mean y"), ("y", "quantile y")} and len(table) == 6
    for key in {(r.y, r.model) for r in table}:
        own = [r for r in table if (r.y, r.model) == key]
        assert [r.chosen for r in own].count(True) == 1 and min(own, key=lambda r: r.loss).chosen
    assert all('"max_depth": 2' in r.params for r in table if r.chosen and r.model in ("class", "mean y"))
    chosen = next(r for r in table if r.model == "mean y" and r.chosen)
    assert model.steps[1].models["y"][0].getNumTrees == chosen.rounds < 16
    assert model.steps[1].r2 > 0.9
    again = load_fusion(spark, model.save(str(tmp_path / "m")))
    assert sorted(map(tuple, again.tuning().collect())) == sorted(map(tuple, table))
    want = model.transform(df, 2).collect()
    assert sorted(map(tuple, again.transform(df, 2).collect())) == sorted(map(tuple, want))
    assert abs(np.mean([r.y for r in want]) - np.mean([r[3] for r in rows])) < 0.5
    with pytest.raises(ValueError):
        DonorFusion(["y"], ["a"], "rid", hyper={"max_depth": [2, 3]}).fit(df)


@pytest.mark.parametrize("n", [2, 3, 5])
def test_numbers_of_quantiles(spark, n):
    assert ptiles(n) == pytest.approx([(k + 0.5) / n for k in range(n)])
    rng = np.random.default_rng(n)
    df = spark.createDataFrame([(k, float(a), float(100 * a + rng.normal(0, 5))) for k, a in enumerate(rng.random(300))], "rid int, a double, y double")
    model = DonorFusion(["y"], ["a"], "rid", quantiles=ptiles(n), nclusters=10, krange=(5, 30), trees=3, iterations=5).fit(df)
    step = model.steps[0]
    assert model.spec.expectations(step) == [f"_e{k}_y" for k in range(n + 1)] and len(step.centers.columns) == 1 + 2 * (n + 1)
    for r in step.centers.collect():
        levels = [r[f"_t{k}"] for k in range(1, n + 1)]
        assert levels == sorted(levels)
    assert 0.9 < step.r2 <= 1 and model.transform(df.limit(20)).count() == 20
    with pytest.raises(ValueError):
        DonorFusion(["y"], ["a"], "rid", quantiles=(0.5,)).fit(df)


def test_r2_and_pools_by_numpy(spark):
    """The pools' sizes by best_k over all distances, their R2 from the centers' own expected means."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(k, float(a), float(50 * a**2 + rng.normal(0, 2)), float(rng.integers(1, 4))) for k, a in enumerate(rng.random(250))], "rid int, a double, y double, w double")
    model = DonorFusion(["y"], ["a"], "rid", "w", nclusters=8, krange=(6, 25), trees=2, iterations=4).fit(df)
    step, spec = model.steps[0], model.spec
    from patchloom.operators.fusion import _featured

    features = spec.expectations(step)
    scaled = spec.scale(step, spec.expect(step, _featured(df.withColumn("_w", F.col("w")), step))).toPandas().sort_values("rid")
    x, y, w = scaled[features].to_numpy(), scaled["y"].to_numpy(), scaled["_w"].to_numpy()
    ssr = sst = 0.0
    means = []
    donors = {}
    for r in step.donors.collect():
        donors.setdefault(r.cid, set()).add(r.donor_id)
    for c in step.centers.collect():
        d2 = ((x - np.array([c[f] for f in features])) ** 2).sum(1)
        order = np.lexsort((scaled["rid"], d2))[:25]
        k = best_k(y[order], w[order], c._t0, [c._t1, c._t2], (0.25, 0.75), 6)
        assert donors[c.cid] == set(scaled["rid"].to_numpy()[order[:k]].tolist())
        ssr += (c._t0 - np.average(y[order[:k]], weights=w[order[:k]])) ** 2
        means.append(c._t0)
    sst = ((np.array(means) - np.mean(means)) ** 2).sum()
    assert step.r2 == pytest.approx(1 - ssr / sst)


def test_block_pools_at_fuse_time(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, float(a), float(a + rng.random()), float(a - rng.random())) for k, a in enumerate(rng.random(200))], "rid int, a double, p double, q double")
    model = DonorFusion([["p", "q"]], ["a"], "rid", nclusters=4, trees=2, iterations=2, k_block=3).fit(df)
    assert model.steps[0].donors.groupBy("cid").count().select(F.max("count")).first()[0] == 30
    narrow, wide = ({(r.p, r.q) for r in model.transform(df, 10, k_block=k).collect()} for k in (1, 30))
    assert len(narrow) <= 4 < len(wide) and wide <= {(r.p, r.q) for r in df.collect()}
    assert len({(r.p, r.q) for r in model.transform(df, 10).collect()}) <= 12
    with pytest.raises(ValueError):
        model.transform(df, 1, k_block=31)


def test_best_k_as_optimal_k(spark):
    rng = np.random.default_rng(4)
    rows, goals = [], {}
    for c in range(12):
        goals[c] = (float(rng.normal(0, 1)), *sorted(float(v) for v in rng.normal(0, 1, 2)))
        rows += [(c, k, float(v), float(w), *goals[c]) for k, v, w in zip(range(1, 61), rng.normal(0, 1, 60), rng.integers(1, 5, 60), strict=True)]
    df = spark.createDataFrame(rows, "cid int, rank int, v double, w double, m double, lo double, hi double")
    want = {r.cid: r.k for r in optimal_k(df, "cid", "v", "w", "m", "lo", "hi").collect()}
    for c, g in goals.items():
        own = [r for r in rows if r[0] == c]
        assert best_k(np.array([r[2] for r in own]), np.array([r[3] for r in own]), g[0], g[1:], (0.25, 0.75), 10) == want[c]
    assert best_k(np.ones(3), np.ones(3), 1.0, (1.0, 1.0), (0.25, 0.75), 10) in (1, 2, 3)


def test_pools_as_top_k(spark):
    rng = np.random.default_rng(6)
    donors = spark.createDataFrame([(k, float(a), float(b), float(k * 2)) for k, (a, b) in enumerate(rng.integers(0, 12, (400, 2)))], "rid int, a double, b double, v double").repartition(5)
    centers = spark.createDataFrame([(k, float(k), float(11 - k)) for k in range(12)], "cid int, a double, b double")
    want = sorted((r.cid, r.rid, r.rank) for r in top_k_donors(donors, centers, 9, "cid", "rid", ["a", "b"]).collect())
    got = donor_pools(donors, centers, 9, "cid", "rid", ["a", "b"], ["v"]).collect()
    assert sorted((r.cid, r.rid, r.rank) for r in got) == want and all(r.v == 2 * r.rid for r in got)


def test_lloyd_and_seeds_by_numpy(spark):
    rng = np.random.default_rng(7)
    points = np.unique(rng.normal(0, 1, (500, 2)).round(2), axis=0)
    weight = rng.integers(1, 6, len(points)).astype(float)
    df = spark.createDataFrame([(*map(float, p), float(w)) for p, w in zip(points, weight, strict=True)], "a double, b double, n double").repartition(4)
    start = seeded_centers(df, ["a", "b"], 15)
    far = np.sqrt(((points - np.array([sorted(points[:, j])[(len(points) - 1) // 2] for j in (0, 1)])) ** 2).sum(1))
    assert len(start) == 15 and {tuple(s) for s in start} <= {tuple(p) for p in points}
    held = sorted(np.sqrt(((start - np.array([sorted(points[:, j])[(len(points) - 1) // 2] for j in (0, 1)])) ** 2).sum(1)))
    assert held[0] == far.min() and held[-1] == far.max()
    got = lloyd(df, ["a", "b"], "n", start, 6, 0.0)
    want = start.copy()
    for _ in range(6):
        near = ((points[:, None] - want[None]) ** 2).sum(2).argmin(1)
        for k in range(len(want)):
            if (near == k).any():
                want[k] = np.average(points[near == k], axis=0, weights=weight[near == k])
    assert np.allclose(got, want)


def test_pools_sent_to_the_tasks_draw_as_joins_do(spark, monkeypatch):
    rng = np.random.default_rng(9)
    pools = spark.createDataFrame([(int(c), k, float(w), k * 10, float(-k)) for k, (c, w) in enumerate(zip(rng.integers(0, 7, 120), rng.integers(0, 4, 120), strict=True))], "cid int, donor_id int, w double, p int, q double")
    rows = spark.createDataFrame([(k, k % 7, float(u)) for k, u in enumerate(rng.random(500))], "id int, cid int, u double")
    want = sampling.donor_draw(rows, pools, "cid", "w", ["p", "q"], F.col("u"), "id", "donor_id").select("id", "p", "q")
    got = sampling.pool_draw(rows, pools, "cid", "w", ["p", "q"], "u", "donor_id")
    assert got.schema["p"].dataType.simpleString() == "int"
    assert sorted(map(tuple, got.select("id", "p", "q").collect())) == sorted(map(tuple, want.collect()))
    odd = sampling.pool_draw(spark.createDataFrame([(1, 99, 0.5), (2, None, 0.5)], "id int, cid int, u double"), pools, "cid", "w", ["p"], "u", "donor_id").collect()
    assert [r.p for r in odd] == [None, None]
    monkeypatch.setattr(sampling, "MOST_DONORS", 100)
    assert sampling.pool_draw(rows, pools, "cid", "w", ["p"], "u", "donor_id") is None


def test_importance_by_counting_the_trees(spark):
    """Cover and frequency against the printed trees, shares that sum to 1, and the order for display."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, float(a), float(b), bool(a > 0.4), float(5 * a + b + rng.normal(0, 0.1))) for k, (a, b) in enumerate(rng.random((300, 2)))], "rid int, a double, b double, z boolean, y double")
    model = DonorFusion(["z", "y"], ["a", "b"], "rid", nclusters=5, krange=(5, 20), trees=2, depth=2, iterations=2).fit(df)
    summary, detailed = (d.collect() for d in model.importance())
    boost = model.steps[1].models["y"][0]
    lines = [x for x in boost.toDebugString.splitlines() if "If (feature" in x]
    features = [int(x.split("feature ")[1].split()[0]) for x in lines]
    names = [*model.steps[1].predictors, *model.steps[1].predictors]
    want = {n: sum(names[f] == n for f in features) / len(features) for n in set(names)}
    got = {r.x: r for r in detailed if (r.y, r.model) == ("y", "mean")}
    assert {n: r.frequency for n, r in got.items()} == pytest.approx(want)
    for key in ("gain", "cover", "frequency"):
        assert sum(r[key] for r in summary if r.y == "y") == pytest.approx(1) and sum(r[key] for r in got.values()) == pytest.approx(1)
    root = boost.trees[0].toDebugString.splitlines()[1]
    assert got[names[int(root.split("feature ")[1].split()[0])]].cover >= 0.3
    places = {r.x: r.place for r in summary}
    assert places == {"z": 1, "b": 2, "a": 3}
