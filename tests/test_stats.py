import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patchloom.functions.random import uniform
from patchloom.functions.stats import denormalize, normalize, signif_within, t_quantile
from patchloom.operators.analyze import analyze, weighted_median


def test_t_quantiles_of_tables(spark):
    known = {1: 6.31375, 2: 2.91999, 3: 2.35336, 4: 2.13185, 9: 1.83311, 30: 1.69726, 1000: 1.64638, None: 1.64485}
    df = spark.createDataFrame([(float(k) if k else None, v) for k, v in known.items()], "df double, want double")
    for r in df.withColumn("t", t_quantile(0.95, F.col("df"))).collect():
        assert r.t == pytest.approx(r.want, abs=5e-5)


def test_normalize_comes_back(spark):
    df = spark.range(50).withColumn("x", F.col("id") * 3.7 - 20)
    z = normalize(F.col("x"), 5.0, 2.0)
    assert df.where(F.abs(denormalize(z, 5.0, 2.0) - F.col("x")) > 1e-9).count() == 0


def test_signif_is_within_tolerance(spark):
    df = spark.createDataFrame([(0.0,), (123456.0,), (-0.00123456,), (None,), (9.996,)], "x double")
    got = [r.y for r in df.select(signif_within(F.col("x"), 0.001).alias("y")).collect()]
    assert got[0] == 0 and got[1] == pytest.approx(123000, rel=0.005) and got[2] == pytest.approx(-0.00123456, rel=1e-3) and got[3] is None


def test_uniform_is_keyed(spark):
    df = spark.range(2000).select(uniform("a", "id").alias("u"), uniform("b", "id").alias("v"))
    r = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.corr("u", "v")).collect()[0]
    assert 0 <= r[0] and r[1] < 1 and abs(r[2] - 0.5) < 0.03 and abs(r[3]) < 0.1


def mean_and_variance(x, w):
    n, s = len(x), sum(w)
    m = sum(a * b for a, b in zip(x, w)) / s
    if set(x) <= {0.0, 1.0}:
        return m, m * (1 - m) * sum(b * b for b in w) / s**2
    return m, n / ((n - 1) * s * s) * sum((b * (a - m)) ** 2 for a, b in zip(x, w)) if n > 1 else None


@settings(deadline=None, max_examples=8)
@given(st.lists(st.tuples(st.floats(-100, 100), st.integers(1, 9)), min_size=2, max_size=30))
def test_estimates_by_hand(spark, rows):
    data = [(m, k, x + m, float(w)) for m in (1, 2, 3) for k, (x, w) in enumerate(rows)]
    df = spark.createDataFrame(data, "M int, rid long, x double, w double")
    r = analyze(df, mean=["x"], weight="w", detail=True).collect()[0]
    each = [mean_and_variance([d[2] for d in data if d[0] == m], [d[3] for d in data if d[0] == m]) for m in (1, 2, 3)]
    est = sum(e for e, _ in each) / 3
    within = sum(v for _, v in each) / 3
    between = sum((e - est) ** 2 for e, _ in each) / 2
    assert r.est == pytest.approx(est, abs=1e-9) and r.N == len(rows)
    assert r.se == pytest.approx(math.sqrt(within + 4 / 3 * between), rel=1e-6, abs=1e-6)


def test_degenerate_groups(spark):
    rows = [(1, 1, "a", 5.0), (2, 1, "a", 6.0), (1, 2, None, 1.0), (2, 2, None, 1.0), (1, 3, "b", None), (2, 3, "b", 2.0)]
    df = spark.createDataFrame(rows, "M int, rid long, g string, x double")
    got = {r.g: r for r in analyze(df, mean=["x"], by=["g"]).collect()}
    assert got["a"].est == 5.5 and got["a"].moe is None and got[None].est == 1.0
    one = analyze(df.where("M = 1"), mean=["x"], by=["g"]).collect()
    assert all(r.moe is None for r in one)
    with pytest.raises(ValueError):
        analyze(df, mean=["x"], weight="none")
    with pytest.raises(ValueError):
        analyze(df, mean=["g"], by=["g"])


def test_weighted_median_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("a", 3.0, 1), ("a", 4.0, 1), ("b", 7.0, 3), ("c", 1.0, 1), ("c", 10.0, 9)], "g string, x double, w int")
    assert {r.g: r.est for r in weighted_median(df, ["g"], "x", "w").collect()} == {"a": 2.5, "b": 7.0, "c": 9.1}


def test_order_and_partitions_do_not_matter(spark):
    rng = random.Random(1)
    rows = [(m, k, rng.randint(0, 9) * 1.0, rng.choice("xy")) for m in (1, 2) for k in range(60)]
    a = spark.createDataFrame(rows, "M int, rid long, x double, g string")
    rng.shuffle(rows)
    b = spark.createDataFrame(rows, a.schema).repartition(7)
    f = lambda df: sorted((r.g, round(r.est, 9)) for r in analyze(df, mean=["x"], by=["g"]).collect())
    assert f(a) == f(b)
