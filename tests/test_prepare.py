import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patchloom.operators import prepare, rank
from patchloom.operators.fusion import all_inflated


def wide(spark, n=600, ys=8, xs=10):
    r = np.random.default_rng(7)
    base = r.normal(size=(n, 4))
    data = np.round(base @ r.normal(size=(4, ys + xs)) + r.normal(size=(n, ys + xs)), 1)
    data[r.random(n) < 0.3, 0] = 0.0
    names = [*(f"y{k}" for k in range(ys)), *(f"x{k}" for k in range(xs))]
    frame = pd.DataFrame(data, columns=names).assign(g=["abcdefg"[k % 7] for k in range(n)], w=1.0 + np.arange(n) % 3)
    return frame, spark.createDataFrame(frame.values.tolist(), ", ".join(f"{c} double" for c in names) + ", g string, w double"), names[:ys], [*names[ys:], "g"]


def test_no_aggregate_has_a_function_for_each_pair(spark, monkeypatch):
    frame, df, ys, xs = wide(spark)
    widths = []
    for kind in (type(df), type(df.groupBy("g"))):
        monkeypatch.setattr(kind, "agg", lambda self, *exprs, _agg=kind.agg: widths.append(len(exprs)) or _agg(self, *exprs))
    order, predictors = prepare.prepare(df, ys, xs, "w")
    got = {(r.y, r.x): r.r for r in rank.spearman(df, ys, xs[:-1]).collect()}
    assert sorted(order) == sorted(ys) and set(predictors) == set(ys)
    assert max(widths) <= len(ys) + len(xs) + 5 < len(ys) * (len(xs) - 1)
    want = frame[[*ys, *xs[:-1]]].rank().corr()
    assert all(got[y, x] == pytest.approx(want.loc[y, x], abs=1e-9) for y in ys for x in xs[:-1])


def test_rank_correlations_of_missing_and_constant_columns(spark):
    rows = [(float(k % 7), None if k % 5 else 1.0, 4.0, None, float(k * k % 11) if k % 3 else None) for k in range(90)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = {(r.y, r.x): r.r for r in rank.spearman(df, ["a", "d"], ["b", "c", "d", "e"]).collect()}
    frame = pd.DataFrame(rows, columns=list("abcde")).astype(float)
    assert got.pop(("a", "e")) == pytest.approx(frame.rank().corr().loc["a", "e"])
    assert len(got) == 7 and set(got.values()) == {None}
    one = rank.spearman(df.limit(1), ["a"], ["c"]).collect() + rank.spearman(df.limit(0), ["a"], ["c"]).collect()
    assert [r.r for r in one] == [None, None]


@pytest.mark.parametrize("most", (0, 4, 10**6))
def test_ranks_by_type_joined_either_way(spark, monkeypatch, most):
    monkeypatch.setattr(rank, "BROADCAST_VALUES", most, raising=False)
    far = 2**53  # neighbours there are one double
    data = [(far + k % 90, float(k * 37 % 101) if k % 6 else None, k % 3, f"{k % 40}.25") for k in range(300)]
    df = spark.createDataFrame(data, "a long, b double, c int, s string").withColumn("d", F.col("s").cast("decimal(10,2)")).drop("s")
    names = ["a", "b", "c", "d"]
    out = rank.ranked(df, names, dense=[f"n{c}" for c in names], average=[f"v{c}" for c in names], upto=[f"u{c}" for c in names])
    assert out.columns == [*names, *(f"{p}{c}" for c in names for p in "nvu")]
    values = {c: sorted(v for r in df.collect() if (v := r[c]) is not None) for c in names}
    for r in out.collect():
        for c in names:
            own = values[c]
            if r[c] is None:
                assert r[f"n{c}"] is None and r[f"v{c}"] is None and r[f"u{c}"] is None
            else:
                upto = sum(v <= r[c] for v in own)
                assert (r[f"n{c}"], r[f"v{c}"], r[f"u{c}"]) == (len({v for v in own if v <= r[c]}), upto - (own.count(r[c]) - 1) / 2, upto)


def test_coded_columns(spark):
    data = [("abcdefg"[k % 7] if k % 9 else None, "_Other_" if k % 2 else "uvwxyz"[k % 6], "one", float(k % 4) if k % 5 else None, k % 2 == 0, None, 3.0) for k in range(210)]
    df = spark.createDataFrame(data, "many string, named string, one string, x double, t boolean, nothing double, flat double")
    made = prepare.coded(df, ["many", "named", "one", "x", "nothing", "flat"], ["t"])
    kept = [c for c in made if c.ends]
    assert {c.origin for c in made} == set(df.columns) and {c.origin for c in kept} == {"many", "named", "x", "t"}
    rows = df.select(*[c.value.alias(f"v{k}") for k, c in enumerate(kept)]).collect()
    for k, c in enumerate(kept):
        assert c.ends == (min(r[k] for r in rows), max(r[k] for r in rows))  # and no nulls
    for name in ("many", "named"):
        own = [k for k, c in enumerate(kept) if c.origin == name]
        assert all(sum(r[k] for k in own) == 1 for r in rows)
        assert len(own) == (5 if name == "many" else 4)


def test_inflated_columns_at_once(spark):
    df = spark.range(2000).selectExpr("if(id % 3 = 0, 0D, 10 + id % 17) as a", "cast(id % 1999 as double) as b", "0D as c", "if(id % 500 = 0, 0D, 5D) as d", "cast(null as double) as e", "if(id % 4 = 0, 0, cast(id % 9 as int)) as f")
    want = [c for c in df.columns if all_inflated(df, [c])]
    assert all_inflated(df, df.columns) == want and "a" in want and not {"b", "c", "d", "e"} & set(want) and all_inflated(df, []) == []
