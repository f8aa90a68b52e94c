import numpy as np
import pandas as pd
import pytest

from patchloom.operators import curves
from patchloom.operators.curves import grid, smooth_quantiles, spline, tree_ends
from patchloom.plans import registry
from patchloom.sources.tables import micro


def slow_tree(y, x, least, price):
    """(cost, x that close the leaves) of the tree over rows in order of x, one split at a time."""
    risk = ((y - y.mean()) ** 2).sum()
    alone = (risk + price, [x[-1]])
    if len(y) < 2 * least or risk <= price:
        return alone
    best = None
    for i in range(least, len(y) - least + 1):
        if x[i] != x[i - 1]:
            both = ((y[:i] - y[:i].mean()) ** 2).sum() + ((y[i:] - y[i:].mean()) ** 2).sum()
            if best is None or both < best[0] - 1e-9:
                best = both, i
    if best is None or best[0] >= risk:
        return alone
    left, right = slow_tree(y[: best[1]], x[: best[1]], least, price), slow_tree(y[best[1] :], x[best[1] :], least, price)
    return (left[0] + right[0], left[1] + right[1]) if left[0] + right[0] < alone[0] else alone


def slow_bins(x, y, a=0.3):
    """(least rows, the three bins of each row), for rows in order of x."""
    n = len(x)
    least = max(5, int(np.ceil(round(n**a, 9))))
    middle = np.median(y)
    mad = 1.4826 * np.median(np.abs(y - middle))
    top = 3.5 * mad + middle
    held = np.where(y - middle > 3.5 * mad, top, np.where(y - middle < -3.5 * mad, -top, y))
    closes = slow_tree(held, x, least, 0.001 * ((held - held.mean()) ** 2).sum())[1]
    stops = np.array([1] + [int((x <= c).sum()) for c in closes])
    bins = []
    for share in (0, 0.5, -0.5):
        at = [max(1, int(np.round(share * (stops[i + 1] - stops[i]) + stops[i]))) for i in range(len(closes))] + [n] + ([1] if share > 0 else [])
        bounds = np.unique(x[np.array(at) - 1])
        bins.append(np.zeros(n, int) if len(bounds) == 1 else pd.cut(x, bounds, labels=False, include_lowest=True))
    return least, bins


def slow_curve(x, y, taus, mad=False, xout=None, cells=None):
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    along = x if cells is None else np.ceil(np.searchsorted(x, x, side="right") * cells / len(x))  # the cell of equal row counts that a row is in
    least, bins = slow_bins(along, y)
    m, w, q = [], [], []
    for k, bin_ in enumerate(bins):
        for b in np.unique(bin_):
            own = bin_ == b
            if own.sum() >= least or (len(x) < least and k == 0):
                m.append(x[own].mean())
                w.append(own.sum())
                q.append([np.sort(y[own])[max(1, -((-own.sum() * round(100 * t)) // 100)) - 1] for t in taus])  # whole numbers: 0.1 * 70 is above 7
    m, w, q = np.array(m), np.array(w, float), np.array(q)
    m = np.where(m == m.min(), x[0], np.where(m == m.max(), x[-1], m))
    at = np.array(xout if xout else grid(x, np.ones(len(x), int), None))
    q = np.c_[q[:, 1] - q[:, 0], q[:, 1], q[:, 2] - q[:, 1]] if mad else q
    out = np.stack([spline(m, v, w, at) for v in q.T], axis=1)
    return at, out if mad else np.sort(out, axis=1)


def agree(rows, x, y, taus, **options):
    at, want = slow_curve(x, y, taus, **options)
    for j, t in enumerate(taus):
        own = sorted((r.x, r.y) for r in rows if r.q == t)
        assert np.allclose([a for a, _ in own], at) and np.allclose([v for _, v in own], want[:, j], rtol=1e-6, atol=1e-6 * np.abs(want).max())


def draws(seed, n):
    r = np.random.default_rng(seed)
    x = np.where(r.random(n) < 0.3, 0.0, np.round(r.gamma(2, 10, n), 1))
    return x, np.round(np.sin(x / 8) * 20 + x + r.standard_t(3, n) * (2 + x / 10), 3)


def test_tree_by_hand():
    for seed in range(12):
        r = np.random.default_rng(seed)
        x = np.sort(r.integers(0, 60, 120)).astype(float)
        y = r.normal(size=120) + np.where(x > 30, 2, 0) * r.integers(0, 2)
        at, n = np.unique(x, return_counts=True)
        ends = tree_ends(n, np.array([y[x == v].sum() for v in at]), np.array([(y[x == v] ** 2).sum() for v in at]), 5, 0.01)
        assert [at[e] for e in ends] == slow_tree(y, x, 5, 0.01 * ((y - y.mean()) ** 2).sum())[1]
    assert tree_ends(np.ones(40), np.repeat([0.0, 1.0], 20), np.repeat([0.0, 1.0], 20), 5) == [19, 39]
    assert tree_ends(np.ones(40), np.ones(40), np.ones(40), 5) == [39]


def test_spline_against_a_dense_fit():
    """The same natural splines from truncated powers, their bend integrated numerically."""
    r = np.random.default_rng(3)
    m, w = np.sort(r.random(40)) * 7 + 2, r.integers(1, 9, 40).astype(float)
    q = np.sin(m) + r.normal(size=40) / 5
    lo, hi = m[0], m[-1]
    knots = np.quantile((m - lo) / (hi - lo), np.linspace(0, 1, 10))

    def basis(t, second=False):
        cube = lambda k: 6 * np.maximum(t - knots[k], 0) if second else np.maximum(t - knots[k], 0) ** 3
        d = [(cube(k) - cube(9)) / (knots[9] - knots[k]) for k in range(9)]
        first = [np.zeros_like(t), np.zeros_like(t)] if second else [np.ones_like(t), t]
        return np.stack(first + [d[k] - d[8] for k in range(8)], axis=1)

    fine = (np.arange(200_000) + 0.5) / 200_000
    bend = basis(fine, True).T @ basis(fine, True) / len(fine)
    held, out = basis((m - lo) / (hi - lo)), np.linspace(0, 12, 30)
    weight = w / w.sum() * 40
    best = None
    ours = spline(m, q, w, m)
    for s in np.logspace(-12, 6, 721):
        inverse = np.linalg.pinv(held.T @ (weight[:, None] * held) + s * bend)
        beta = inverse @ held.T @ (weight * q)
        free = 40 - np.trace(inverse @ held.T @ (weight[:, None] * held))
        score = 40 * (weight * (q - held @ beta) ** 2).sum() / free**2
        if best is None or score < best[0]:
            best = score, beta
    assert np.abs(held @ best[1] - ours).max() < 0.02
    assert np.abs(basis((out - lo) / (hi - lo)) @ best[1] - spline(m, q, w, out)).max() < 0.15
    assert np.allclose(spline(m, 3 * m - 1, w, out), 3 * out - 1, atol=1e-6)
    assert np.allclose(spline(np.array([2.0, 2.0]), np.array([1.0, 4.0]), np.array([1.0, 2.0]), out), 3.0)


@pytest.mark.parametrize("n", [3, 60, 1500])
def test_curves_by_hand(spark, n):
    x, y = draws(n, n)
    odd = [(None, 1.0, "a"), (1.0, None, "a"), (float("nan"), 1.0, "a"), (1.0, float("nan"), None)]
    df = spark.createDataFrame([*zip(map(float, x), map(float, y), ["a", None] * n), *odd], "x0 double, y0 double, g string")
    taus = [0.1, 0.5, 0.9]
    got = smooth_quantiles(df, "x0", "y0", taus).collect()
    agree(got, x, y, taus)
    agree(smooth_quantiles(df, "x0", "y0", "mad", xout=[1.0, 5.0, 90.0]).collect(), x, y, [0.25, 0.5, 0.75], mad=True, xout=[1.0, 5.0, 90.0])
    by = smooth_quantiles(df, "x0", "y0", taus, groups=["g"]).collect()
    for k, g in enumerate(("a", None)):
        agree([r for r in by if r.g == g], x[k::2], y[k::2], taus)


def test_more_rows_than_cells(spark, monkeypatch):
    monkeypatch.setattr(curves, "MOST_CELLS", 100)
    x, y = draws(5, 4000)
    rows = [(float(a), float(b)) for a, b in zip(x, y, strict=True)]
    got = smooth_quantiles(spark.createDataFrame(rows, "x double, y double"), "x", "y", [0.25, 0.5, 0.75]).toPandas()
    agree(list(got.itertuples()), x, y, [0.25, 0.5, 0.75], xout=sorted(set(got.x)), cells=100)
    crossed = got.pivot(index="x", columns="q", values="y")
    assert (crossed[0.25] <= crossed[0.5]).all() and (crossed[0.5] <= crossed[0.75]).all()


def test_odd_tables(spark):
    schema = "x double, y double"
    assert smooth_quantiles(spark.createDataFrame([], schema), "x", "y").count() == 0
    assert {(r.x, r.y) for r in smooth_quantiles(spark.createDataFrame([(2.0, 7.0)] * 9, schema), "x", "y").collect()} == {(2.0, 7.0)}
    for bad in (dict(quantiles=[0.0]), dict(quantiles=[]), dict(a=0.0), dict(xout=[1.0]), dict(groups=["q"])):
        with pytest.raises(ValueError):
            smooth_quantiles(spark.createDataFrame([], schema + ", q double"), "x", "y", **bad)


def test_query(spark, data_dir):
    got = registry.queries()["quantile_curves"](spark, data_dir).collect()
    whole = micro(spark, data_dir).select("region", "qty", "totalprice").toPandas()
    assert {r.region for r in got} == set(whole.region)
    for region, own in whole.groupby("region"):
        agree([r for r in got if r.region == region], own.qty.to_numpy(float), own.totalprice.to_numpy(float), [0.1, 0.5, 0.9])
