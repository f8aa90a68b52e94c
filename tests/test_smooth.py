import json

import duckdb
import numpy as np
import pytest

from patchloom.operators import smooth, validate
from patchloom.operators.monotonic import monotonic
from patchloom.operators.smooth import in_order, super_smoothed, super_smoothed_sql


def slow_lines(x, y, w, span):
    """(line, leverage) of each point over its window, one least-squares fit at a time."""
    n = len(x)
    half = max(2, int(0.5 * span * n + 0.5))
    full = min(2 * half + 1, n)
    out, own = [], []
    for i in range(n):
        lo = max(0, min(i - half, n - full))
        k = slice(lo, lo + full)
        xm, ym = np.average(x[k], weights=w[k]), np.average(y[k], weights=w[k])
        var, cov = (w[k] * (x[k] - xm) ** 2).sum(), (w[k] * (x[k] - xm) * (y[k] - ym)).sum()
        out.append(ym + (cov / var if var > 1e-12 else 0) * (x[i] - xm))
        own.append(w[i] * (1 / w[k].sum() + ((x[i] - xm) ** 2 / var if var > 1e-12 else 0)))
    return np.array(out), np.array(own)


def slow_smooth(x, y, w):
    if len(x) < 40:
        return slow_lines(x, y, w, 0.3)[0]
    spans = (0.05, 0.2, 0.5)
    fits = [slow_lines(x, y, w, s) for s in spans]
    judged = [slow_lines(x, np.abs(y - f) / np.maximum(1 - h, 1e-9), w, 0.2)[0] for f, h in fits]
    best = np.array(spans)[np.argmin(judged, axis=0)]
    at = np.clip(slow_lines(x, best, w, 0.2)[0], 0.05, 0.5)
    mixed = np.array([np.interp(s, spans, [f[0][i] for f in fits]) for i, s in enumerate(at)])
    return slow_lines(x, mixed, w, 0.05)[0]


def points(seed, sizes):
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in sizes.items():
        for x in rng.uniform(-3, 9, n).round(1 if n > 100 else 6):
            rows.append((g, float(x), float(np.sin(3 * x) * (x < 2) + x + rng.normal(0, 0.3)), float(rng.integers(1, 4))))
    return rows


def expected(rows):
    out = {}
    for g in {r[0] for r in rows}:
        own = {}
        for _, x, y, w in (r for r in rows if r[0] == g):
            a = own.setdefault(x, [0.0, 0.0])
            a[0] += w
            a[1] += w * y
        x = np.array(sorted(own))
        w, y = np.array([own[v][0] for v in x]), np.array([own[v][1] / own[v][0] for v in x])
        out |= {(g, a): b for a, b in zip(x.tolist(), slow_smooth(x, y, w).tolist(), strict=True)}
    return out


@pytest.mark.parametrize("rows_a_range", [50_000, 60])
def test_super_smoother(spark, monkeypatch, rows_a_range):
    """Against one fit a point; groups of 1, 2, 5, 39, 40, 120 and about 110 distinct x, one without a name, in one range and in several."""
    monkeypatch.setattr(smooth, "RANGE_ROWS", rows_a_range)
    rows = points(2, {"a": 1, "b": 2, "c": 5, "d": 39, "e": 40, None: 90, "g": 400})
    got = super_smoothed(spark.createDataFrame(rows, "g string, x double, y double, w double").repartition(5), "x", "y", ["g"], "w").collect()
    want = expected(rows)
    assert {(r.g, r.x) for r in got} == set(want) and len(got) == len(want)
    assert [r.smooth for r in got] == pytest.approx([want[r.g, r.x] for r in got], abs=1e-6)


def test_super_smoother_without_groups(spark):
    rows = points(3, {"a": 200})
    want = expected(rows)
    df = spark.createDataFrame([*rows, ("a", None, 1.0, 1.0), ("a", 1.0, None, 1.0), ("a", 1.0, 5.0, 0.0)], "g string, x double, y double, w double")
    got = super_smoothed(df, "x", "y", (), "w").collect()
    assert [r.smooth for r in got] == pytest.approx([want["a", r.x] for r in got], abs=1e-6) and len(got) == len(want)
    assert super_smoothed(df.limit(0), "x", "y").collect() == []
    with duckdb.connect() as con:
        con.execute("create table t as select unnest($1) as x, unnest($2) as y, unnest($3) as w", [[r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]])
        again = dict(con.sql(f"WITH {super_smoothed_sql('t', [], 'x', 'y', 'w')} SELECT x, smooth FROM smooth").fetchall())
    assert again == pytest.approx({r.x: r.smooth for r in got}, abs=1e-6)


def test_in_order_takes_many_ranges(spark, monkeypatch):
    """Places and running sums of one ungrouped table, worked out in many ranges."""
    monkeypatch.setattr(smooth, "RANGE_ROWS", 100)
    df = spark.range(2500).selectExpr("id * 7919 % 2503 as x", "cast(id as double) as v").repartition(4)
    got = sorted((r.x, r._r, r._n, r._c_v) for r in in_order(df, [], "x", ["v"]).collect())
    rows = sorted((i * 7919 % 2503, float(i)) for i in range(2500))
    assert [g[:3] for g in got] == [(x, k + 1, 2500) for k, (x, _) in enumerate(rows)]
    assert [g[3] for g in got] == np.cumsum([v for _, v in rows]).tolist()
    sizes = [r["count"] for r in smooth.placed(df, [], "x").groupBy("_part").count().collect()]
    assert len(sizes) == 25 and max(sizes) < 200


def slow_monotonic(rows, expend, preserve):
    """By the definition, for one group of (x, y, w)."""
    x, y, w = (np.array(v, float) for v in zip(*rows, strict=True))
    least = y[y > 0].min() if (y > 0).any() else 0.0
    fixed = np.where(x == 0, 0.0, np.where(y == 0, least, y)) if expend else y
    u = np.unique(x)
    uw, uy = np.array([w[x == v].sum() for v in u]), np.array([np.average(fixed[x == v], weights=w[x == v]) for v in u])
    s = slow_smooth(u, uy, uw)
    rising = len(u) < 2 or s.std() == 0 or np.corrcoef(u, s)[0, 1] >= 0
    p = np.sort(s) if rising else np.sort(s)[::-1]
    low = lambda v: np.where(u == 0, 0.0, np.maximum(v, least)) if expend else v
    p = low(p)
    if preserve:
        p = low(p * ((w * y).sum() / (uw * p).sum()))
    return dict(zip(u.tolist(), p.tolist(), strict=True))


@pytest.mark.parametrize(("expend", "preserve"), [(True, True), (True, False), (False, True)])
def test_monotonic_by_definition(spark, expend, preserve):
    rng = np.random.default_rng(6)
    rows = [(k, "ab"[k % 2], float(max(0, rng.integers(-20, 200))), float(max(0, rng.normal(50, 30))), float(rng.integers(1, 4))) for k in range(600)]
    rows = [(k, g, x, y + (x if g == "a" else 200 - x) / 2, w) for k, g, x, y, w in rows]
    df = spark.createDataFrame(rows, "id int, g string, x double, y double, w double")
    want = {g: slow_monotonic([r[2:] for r in rows if r[1] == g], expend, preserve) for g in "ab"}
    got = monotonic(df, "x", "y", "id", ["g"], "w", preserve, expend).collect()
    assert len(got[0]) == 6
    assert sorted((r.id, r.y) for r in got) == sorted((r[0], r[3]) for r in rows)
    assert [r.y_mono for r in got] == pytest.approx([want[r.g][r.x] for r in got], rel=1e-6)
    whole = slow_monotonic([r[2:] for r in rows], expend, preserve)
    got = monotonic(df, "x", "y", "id", (), "w", preserve, expend).collect()
    assert [r.y_mono for r in got] == pytest.approx([whole[r.x] for r in got], rel=1e-6)


def test_report_holds_curves_to_their_variables_and_writes_charts(spark, tmp_path):
    """Bounds are of each variable, not of all; a spike's bin is no higher than its values; charts are read back."""
    rng = np.random.default_rng(1)
    rows = [("a", None, int(n), float(e), float(min(1, 1 - e)), 1.0 + float(e)) for n, e in zip(rng.integers(30, 900, 120), rng.random(120) / 10, strict=True)]
    rows += [("b", "x", int(n), float(5 + e), 0.0, 2.0) for n, e in zip(rng.integers(30, 900, 60), rng.random(60), strict=True)] + [("b", "x", 50, 900.0, None, 2.0)]
    df = spark.createDataFrame(rows, "y string, level string, n long, err double, vad double, moe_ratio double")
    got = validate.report(df, 1000, 10)
    smooth_ = got.smooth.collect()
    assert len(smooth_) == 60 and {(r.y, r.level) for r in smooth_} == {("a", None), ("b", "x")}
    for r in smooth_:
        own = [x[{"err": 3, "vad": 4, "moe_ratio": 5}[r.metric]] for x in rows if x[0] == r.y]
        own = [v for v in own if v is not None]
        assert min(own) <= r.value <= max(own)
    means = {r.y: r for r in got.means.collect()}
    assert means["a"].err == pytest.approx(np.mean([r.value for r in smooth_ if (r.y, r.metric) == ("a", "err")])) and means["b"].moe_ratio == 2
    path = validate.write_charts(got.charts, str(tmp_path / "charts"))
    charts = {r.name: json.loads(r.value) for r in spark.read.text(path).collect()}
    assert set(charts) == {"allvars_err", "allvars_vad", "allvars_moe_ratio", "a_err", "a_vad", "a_moe_ratio", "b_x_err", "b_x_vad", "b_x_moe_ratio"}
    assert [s["series"] for s in charts["allvars_err"]["data"]["series"]] == ["a", "b = x"] and charts["allvars_vad"]["y"]["reference"] == 1
    assert len(charts["b_x_err"]["data"]["points"]) == 60 and charts["b_x_err"]["name"] == "b_x_err"  # the spike is no point
    assert validate.report(df.limit(0), 1000).smooth.collect() == []
