import numpy as np
import pandas as pd

from patchloom.operators.fusion import impute_by_fusion
from patchloom.operators.screen import impute_screen, plausible_ranks

TYPES = "a double, b int, c string, d boolean, `e f` double"


def slow_ranks(df: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in df:
        v = df[c]
        if c in ("a", "b", "e f"):
            z = v.astype(float).rank(method="dense")
        elif c == "d":
            z = v.astype(float)
        else:
            counts = v.value_counts()
            mode = min(counts[counts == counts.max()].index) if len(counts) else None
            z = (v == mode).astype(float).where(v.notna())
        out[c] = z.fillna(z.median()).fillna(0.0)
    return pd.DataFrame(out)


def rows(seed, n):
    r = np.random.default_rng(seed)
    pick = lambda v, share: None if r.random() < share else v
    return [(pick(float(r.normal()), 0.2), pick(int(r.integers(0, 4)), 0.3), pick("xyz"[r.integers(0, 3)], 0.1), pick(bool(r.random() < 0.5), 0.2), None) for _ in range(n)]


def test_ranks_by_hand(spark):
    for seed, n in ((1, 40), (2, 41), (3, 1), (4, 700)):
        data = rows(seed, n)
        frame = pd.DataFrame(data, columns=["a", "b", "c", "d", "e f"]).astype({"a": float, "b": float, "c": object, "d": object, "e f": float})
        got = plausible_ranks(spark.createDataFrame(data, TYPES), ["a", "b", "c", "d", "e f"]).collect()
        want = slow_ranks(frame)
        assert sorted(map(tuple, got)) == sorted(map(tuple, want.itertuples(index=False)))


def test_screen_by_hand(spark):
    data = rows(5, 500)
    want = slow_ranks(pd.DataFrame(data, columns=["a", "b", "c", "d", "e f"]).astype({"a": float, "b": float, "c": object, "d": object, "e f": float}))
    got = impute_screen(spark.createDataFrame(data, TYPES), ["a", "c"], ["a", "b", "c", "d", "e f"], threshold=0.0, least=3, most=3).collect()
    with np.errstate(all="ignore"):
        for y in ("a", "c"):
            r = {x: float(np.nan_to_num(np.corrcoef(want[y], want[x])[0, 1])) for x in want if x != y}
            best = sorted(r, key=lambda x: (-abs(r[x]), x))[:3]
            own = {g.x: g.r for g in got if g.y == y}
            assert set(own) == set(best) and all(abs(own[x] - r[x]) < 1e-9 for x in best)


def test_few_that_pass_are_topped_up_and_many_are_cut(spark):
    r = np.random.default_rng(6)
    y = r.normal(size=400)
    wide = np.c_[y, *[y + r.normal(size=400) for _ in range(8)], *[r.permutation(400) * 0.0 for _ in range(3)]]
    names = ["y", *[f"x{k}" for k in range(8)], "z0", "z1", "z2"]
    df = spark.createDataFrame([tuple(map(float, w)) for w in wide], ", ".join(f"{n} double" for n in names))
    assert {g.x for g in impute_screen(df, ["y"], names).collect()} == {f"x{k}" for k in range(8)}
    assert impute_screen(df, ["y"], names, most=6).count() == 6
    assert {g.x for g in impute_screen(df, ["y"], ["y", "x3", "z2", "z0", "z1"], least=3).collect()} == {"x3", "z0", "z1"}
    assert {g.r for g in impute_screen(df.limit(0), ["y"], names).collect()} == {0.0}


def test_imputation_uses_the_screened_predictors_alone(spark):
    related = [f"id % 3 + (id * {k}) % 5 as x{k}" for k in range(1, 6)]
    df = spark.range(600).selectExpr("id as rid", *related, "7 as z", "case when id % 5 > 0 then cast(id % 3 as string) end as c")
    out = impute_by_fusion(df, "rid", screen=True, trees=3, iterations=2)
    plain = impute_by_fusion(df, "rid", screen=False, ignore=["z"], trees=3, iterations=2)
    assert out.where("c is null").count() == 0 and out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect()))
