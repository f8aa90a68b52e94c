import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.operators import encode, monotonic, neighbors, prepare, sampling, validate
from patchloom.operators.fusion import DonorFusion, impute_by_fusion, load_fusion, zero_inflated
from patchloom.operators.rank import ranked, spearman
from patchloom.operators.rank import pieces
from patchloom.sources import fsd
from patchloom.sources.tables import micro


def test_ranks_over_many_parts(spark):
    df = spark.createDataFrame([(k, float(k * 7 % 50)) for k in range(200)] + [(999, None)], "id long, x double")
    values = sorted(float(k * 7 % 50) for k in range(200))
    for r in ranked(df, "x", dense="d", average="a").collect():
        if r.x is None:
            assert r.d is None and r.a is None
            continue
        assert r.d == sorted(set(values)).index(r.x) + 1
        assert r.a == values.index(r.x) + 1 + (values.count(r.x) - 1) / 2


def test_strata_are_even(spark):
    df = spark.createDataFrame([(k, float(k // 3)) for k in range(101)], "id long, y double")
    n = [r["count"] for r in sampling.strata(df, "y", 4, "id").groupBy("stratum").count().orderBy("stratum").collect()]
    assert n == [26, 25, 25, 25]


def test_donor_draw_copies_whole_donors(spark):
    donors = spark.createDataFrame([(g, i, float(w), i * 10, f"v{i}") for g in (1, 2) for i, w in ((g * 100 + k, k) for k in range(1, 5))], "cid int, donor long, w double, a long, b string")
    asks = spark.createDataFrame([(k, 1 + k % 2, k / 400) for k in range(400)], "id long, cid int, u double")
    got = sampling.donor_draw(asks, donors, "cid", "w", ["a", "b"], F.col("u"), "id", "donor").collect()
    assert len(got) == 400 and all(r.a == r.donor * 10 and r.b == f"v{r.donor}" and r.donor // 100 == r.cid for r in got)
    share = sum(r.donor % 100 == 4 for r in got) / 400
    assert share == pytest.approx(0.4, abs=0.02)


def test_donor_draw_against_a_search(spark):
    weights = [0.0, 3.0, 0.0, 0.0, 1.0, 400.0, 0.0, 2.0]
    rows = [(g, f"{k:03d}", w) for g in "ab" for k, w in enumerate(weights)]
    u = [k / 4096 for k in range(4096)]
    asks = spark.createDataFrame([(k, "a" if k % 3 else "b", v) for k, v in enumerate(u)], "id long, g string, u double")
    ends = np.cumsum(weights)
    for kind in ("string", "int"):
        donors = spark.createDataFrame(rows, "g string, donor string, w double").withColumn("donor", F.col("donor").cast(kind))
        got = {r.id: int(r.donor) for r in sampling.donor_draw(asks, donors, "g", "w", [], F.col("u"), "id", "donor").collect()}
        assert got == {k: int(np.searchsorted(ends, v * ends[-1], "right")) for k, v in enumerate(u)}


def test_donor_draw_by_many_text_ids(spark):
    """Ids in ranges between sampled cuts, some donors without weight, some ids beyond ASCII."""
    rng = np.random.default_rng(8)
    ids = sorted({f"{chr(int(c))}{k}" for k, c in enumerate(rng.choice([65, 97, 233, 0x4E00, 0x1F600], 900))})
    weights = rng.integers(0, 4, len(ids)).astype(float)
    donors = spark.createDataFrame([(1, i, float(w)) for i, w in zip(ids, weights, strict=True)], "g int, donor string, w double")
    cuts = sampling.text_cuts(donors, "donor", 20)
    parts = donors.select(sampling.text_interval("donor", cuts).alias("part"), "donor").collect()
    assert len(cuts) == 19 and all(r.part == sum(c < r.donor for c in cuts) for r in parts)
    u = [k / 1024 for k in range(1024)]
    got = sampling.donor_draw(spark.createDataFrame([(k, 1, v) for k, v in enumerate(u)], "id long, g int, u double"), donors, "g", "w", [], F.col("u"), "id", "donor").collect()
    ends = np.cumsum(weights)
    assert {r.id: r.donor for r in got} == {k: ids[int(np.searchsorted(ends, v * ends[-1], "right"))] for k, v in enumerate(u)}


def test_pieces_follow_the_rows():
    assert [pieces(n) for n in (0, 10**6, 10**8, 10**12)] == [64, 64, 200, 4096]


def test_samples_and_folds_are_even(spark):
    df = spark.createDataFrame([(k, "a" if k < 3 else "b") for k in range(503)], "id long, g string")
    got = {(r.g, r.fold): r["count"] for r in sampling.k_folds(df, "g", 5, "t", "id").groupBy("g", "fold").count().collect()}
    assert got == {("a", 1): 1, ("a", 2): 1, ("a", 3): 1} | {("b", k): 100 for k in range(1, 6)}
    kept = sampling.stratified_sample(df, "g", 0.3, "t", "id")
    assert {r.g: r["count"] for r in kept.groupBy("g").count().collect()} == {"a": 1, "b": 150} and kept.columns == ["id", "g"]


def test_lump_and_table(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] + [(None,)], "g string")
    assert {r.g for r in encode.lump_levels(df, "g", 3).collect()} == {"a", "b", "_Other_"}
    assert {r.g for r in encode.lump_levels(df, "g", 4).collect()} == {"a", "b", "c", None}
    assert {r.g: r.freq for r in encode.weighted_table(df, "g").collect()} == {"a": 5, "b": 3, "c": 1, None: 1}


def test_monotone_output_keeps_the_mean(spark):
    df = spark.createDataFrame([(k, float(k % 40), max(0.0, (k % 40) * 2.0 + (k * 37 % 11) - 5)) for k in range(400)], "id long, x double, y double")
    got = monotonic.monotonic(df, "x", "y", "id", expend=False).orderBy("x").collect()
    values = [r.y_mono for r in got]
    assert all(a <= b + 1e-9 for a, b in zip(values, values[1:]))
    assert sum(values) == pytest.approx(sum(r.y for r in got), rel=1e-6)
    fixed = monotonic.monotonic(df, "x", "y", "id").collect()
    assert all((r.y_mono == 0) == (r.x == 0) for r in fixed)
    with pytest.raises(Exception, match="negative"):
        monotonic.expend_fixups(df.withColumn("y", -F.col("y") - 1), "x", "y").collect()


def test_interpolation_holds_the_ends(spark):
    knots = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 30.0)], "g string, x double, y double")
    asks = spark.createDataFrame([(1, "a", 0.0), (2, "a", 2.0), (3, "a", 3.0), (4, "a", 9.0)], "id long, g string, x double")
    assert {r.id: r.y_hat for r in monotonic.interpolated(asks, knots, ["g"], "x", "y", "id").collect()} == {1: 10.0, 2: 20.0, 3: 30.0, 4: 30.0}


def test_centers_are_bounded(spark):
    many = spark.range(neighbors.MAX_CENTERS + 1).select(F.col("id").cast("int").alias("cid"), F.col("id").cast("double").alias("x"))
    with pytest.raises(ValueError):
        neighbors.nearest_center(many, many, "cid", ["x"])


def test_subset_shares_tell_null_from_unused(spark):
    df = spark.createDataFrame([("a", None)] * 40 + [("b", "u")] * 40, "g string, h string")
    got = {(r.subset, r.g, r.h): r.share for r in validate.subset_shares(df, ["g", "h"], 80).collect()}
    assert got[("h", None, None)] == 0.5 and got[("g*h", "a", None)] == 0.5 and len(got) == 6
    assert len(validate.subsets(["a", "b", "c"])) == 6


def test_write_read_and_catalog(spark, tmp_path):
    df = sampling.implicates(spark.range(10).withColumn("v", F.col("id") * 2), 4)
    path = fsd.write_implicates(df, str(tmp_path / "set.fsd"))
    assert fsd.read_implicates(spark, path, ["id"], m=2).count() == 20
    match = spark.createDataFrame([(3,), (3,), (4,)], "id long")
    part = fsd.read_implicates(spark, path, m=None, match=match)
    assert part.count() == 8
    plan = fsd.read_implicates(spark, path, ["id"], m=1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(M" in plan
    assert {r["var"] for r in fsd.catalog(spark, str(tmp_path)).collect()} == {"id", "v", "M"}


def test_order_of_fusion(spark, data_dir):
    order, predictors = prepare.prepare(micro(spark, data_dir), ["qty", "totalprice"], ["n_lines", "mon"])
    assert sorted(order) == ["qty", "totalprice"] and "n_lines" in predictors["qty"]


def test_order_of_fusion_takes_categories_blocks_and_zeros(spark):
    def row(k):
        a, g = (k * 37 % 101) / 10, "uvwxyz"[k % 6]
        noise = (k * 7919 % 97) / 97
        return k, a if k % 50 else None, g if k % 40 else None, noise, 7.0, a * 3 + noise, 0.0 if k % 3 == 0 else 20 + a, "hi" if a > 5 else "lo", a > 3, 1.0 + k % 4

    df = spark.createDataFrame([row(k) for k in range(600)], "id long, `a.b` double, g string, c0 double, flat double, y double, z double, s string, t boolean, w double")
    order, predictors = prepare.prepare(df, [["y", "z"], "s", "t"], ["a.b", "g", "c0", "flat"], "w", xforce=["g"])
    assert sorted(map(str, order)) == ["['y', 'z']", "s", "t"] and set(predictors) == {"y", "z", "s", "t"}
    assert all(p[0] == "a.b" or p[0] in "yzst" for p in predictors.values()) and predictors["y"] == predictors["z"]
    assert all("g" in p and "flat" not in p and len(set(p)) == len(p) for p in predictors.values())
    assert not any(x.endswith("_zero") or ".." in x for p in predictors.values() for x in p)
    few = prepare.prepare(df, ["y"], ["a.b", "c0"], xmax=1, fraction=0.5)
    assert few[0] == ["y"] and few[1]["y"][0] == "a.b"
    for bad in (dict(y=[], x=["c0"]), dict(y=["y"], x=["y"]), dict(y=["y"], x=["c0"], xforce=["g"]), dict(y=["y"], x=["c0"], xmax=0), dict(y=["y"], x=["flat"]), dict(y=["y"], x=["c0"], fraction=0.0)):
        with pytest.raises(ValueError):
            prepare.prepare(df, **bad)


def test_correlations_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 3)) + 1e4
    x[::4, 1] = 0.0
    w = rng.integers(1, 6, 400).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, w)], "a double, b double, c double, w double").repartition(7)
    means, found = prepare.correlations(df, ["a", "b", "c"], "w", ["b"])
    assert means == pytest.approx(np.average(x, axis=0, weights=w))
    some = x[:, 1] != 0
    for name, rows in (("", slice(None)), ("b", some)):
        cov = np.cov(x[rows].T, aweights=w[rows], bias=True)
        sd = np.sqrt(np.diag(cov))
        assert found[name] == pytest.approx(cov / np.outer(sd, sd), abs=1e-8)


def test_rank_correlations_against_pandas(spark):
    rows = [(k * 37 % 53 / 1.0, None if k % 9 == 0 else float(k * k % 31), float(k % 2)) for k in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, f double")
    got = {(r.y, r.x): r.r for r in spearman(df, ["a", "f"], ["b"], flags=["f"]).collect()}
    # ranks are over all values of a column; pairs with a null are left out of the correlation
    want = df.toPandas().rank().corr()
    assert got == pytest.approx({("a", "b"): want.loc["a", "b"], ("f", "b"): want.loc["f", "b"]})


def test_fusion_draws_donor_values(spark, data_dir, tmp_path):
    base = micro(spark, data_dir).cache()
    donors, recipients = base.where("rid % 2 = 1"), base.where("rid % 2 = 0")
    model = DonorFusion(["status", ["disc_share", "tax_share"]], ["region", "n_lines"], "rid", "weight", nclusters=5, trees=3, iterations=2, krange=(5, 20)).fit(donors)
    model.save(str(tmp_path / "model"))
    n = recipients.count()
    out = load_fusion(spark, str(tmp_path / "model")).transform(recipients, 2, retain=["region"]).collect()
    assert len(out) == 2 * n and {r.M for r in out} == {1, 2}
    pairs = {(r.disc_share, r.tax_share) for r in donors.collect()}
    assert all((r.disc_share, r.tax_share) in pairs and r.status in ("F", "O", "P") for r in out)
    again = model.transform(recipients.repartition(5), 2).collect()
    assert sorted((r.M, r.rid, r.status, r.disc_share) for r in again) == sorted((r.M, r.rid, r.status, r.disc_share) for r in out)
    summary, _ = model.importance()
    assert {round(r.total, 6) for r in summary.groupBy("y").agg(F.sum("gain").alias("total")).collect()} <= {1.0}
    for bad in (dict(y=[], x=["n_lines"]), dict(y=["qty"], x=["qty"]), dict(y=["M"], x=["n_lines"]), dict(y=["nope"], x=["n_lines"])):
        with pytest.raises(ValueError):
            DonorFusion(bad["y"], bad["x"], "rid").fit(donors)
    with pytest.raises(ValueError):
        model.transform(recipients.drop("region"))


def test_imputation_fills_everything(spark, data_dir):
    df = micro(spark, data_dir).select("rid", "region", "n_lines", F.when(F.col("rid") % 5 != 0, F.col("status")).alias("status"))
    out = impute_by_fusion(df, "rid", trees=3, iterations=2)
    assert out.where("status is null").count() == 0 and out.count() == df.count()
    assert out.join(df.where("status is not null"), ["rid", "status"]).count() == df.where("status is not null").count()


def test_zero_inflation(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 4 == 0, 0.0).otherwise(F.col("id") / 10 + 30).alias("z"), (F.col("id") / 500 - 1).alias("plain"))
    assert zero_inflated(df, "z") and not zero_inflated(df, "plain")


def test_default_donor_pools_reach_every_expectation(spark):
    df = spark.range(900).select(F.col("id").alias("rid"), (F.col("id") % 30).alias("a"), F.floor(F.col("id") / 30).alias("b"), (F.col("id") * F.col("id") % 977 + 200).cast("double").alias("y"))
    spec = DonorFusion(["y"], ["a", "b"], "rid", trees=3)
    assert (spec.nclusters, spec.krange) == (2000, (10, 500))
    assert spec.fit(df).steps[0].centers.count() > 40
    points = spark.range(300).select(F.col("id").cast("double").alias("a"))
    assert len(DonorFusion(["y"], ["x"], "rid", nclusters=300)._centers(points, ["a"])) == 300
    assert len(DonorFusion(["y"], ["x"], "rid", nclusters=299)._centers(points, ["a"])) == 299


def test_many_centers(spark):
    df = spark.range(500).select(F.col("id").alias("rid"), F.when(F.col("id") != 7, F.col("id") % 50 + 0.5).alias("v"))
    centers = spark.range(2000).select(F.col("id").cast("int").alias("cid"), (F.col("id") / 40).alias("v"))
    got = {r.rid: r for r in neighbors.nearest_center(df.repartition(3), centers, "cid", ["v"]).collect()}
    assert len(got) == 500 and got[7].cid is None and got[7].dist2 is None
    assert all((r.cid, r.dist2) == (40 * (i % 50) + 20, 0.0) for i, r in got.items() if i != 7)
    near = neighbors.top_k_donors(df.repartition(5), centers, 12, "cid", "rid", ["v"]).where("cid = 21").orderBy("rank").collect()
    want = sorted(((i % 50 + 0.5 - 21 / 40) ** 2, i) for i in range(500) if i != 7)[:12]
    assert [(r.dist2, r.rid) for r in near] == want
