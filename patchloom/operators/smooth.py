"""Friedman's super-smoother over distinct x, by running sums that no group's task works out alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.operators.rank import interval
from patchloom.sources.scratch import stored

#: Rows that a range of values is to have, and ranges at most.
RANGE_ROWS, MOST_RANGES = 50_000, 4096
#: Shares of a group's points that the three smoothers take in (fixed values of the published algorithm), and that of small groups.
TWEETER, MIDRANGE, WOOFER, FEW, FEW_SPAN = 0.05, 0.2, 0.5, 40, 0.3


def met(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins on keys, nulls being equal; right's keys go."""
    names = [f"_key{k}" for k in range(len(keys))]
    other = right.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return left.join(other, same, how).drop(*names)


def placed(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Adds _part, the range of x that a row is in, _r, its place by x in its group from 1, and _n, the group's rows.

    Rows of a group need distinct x, which must not be null. Places inside a range are moved by the rows of the ranges
    before, so the tasks are as many as the rows ask for, however few the groups. df is read several times.
    """
    ranges = min(MOST_RANGES, -(-df.count() // RANGE_ROWS))
    cuts = sorted(set(df.approxQuantile(x, [k / ranges for k in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    held = df.withColumn("_part", interval(x, cuts))
    order = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(x)).cast("long")
    if not cuts:
        return held.withColumns({"_r": order, "_n": F.count("*").over(Window.partitionBy(*keys, "_part"))})
    cells = held.groupBy(*keys, "_part").agg(F.count("*").alias("_k"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(*keys, "_part", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_start"), F.sum("_k").over(Window.partitionBy(*keys)).alias("_n"))
    return met(held, starts, [*keys, "_part"]).withColumn("_r", F.col("_start") + order).drop("_start")


def running_sums(df: DataFrame, keys: Sequence[str], x: str, sums: Sequence[str]) -> DataFrame:
    """Adds _c_<column>, the sum of each column over a placed row and those before it in its group."""
    upto = Window.partitionBy(*keys, "_part").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    inside = {f"_c_{s}": F.sum(s).over(upto) for s in sums}
    if df.where("_part > 0").limit(1).count() == 0:
        return df.withColumns(inside)
    cells = df.groupBy(*keys, "_part").agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(*keys, "_part", *[F.coalesce(F.sum(f"_s_{s}").over(before), F.lit(0.0)).alias(f"_s_{s}") for s in sums])
    return met(df, starts, [*keys, "_part"]).withColumns({c: F.col(f"_s{c[2:]}") + v for c, v in inside.items()}).drop(*[f"_s_{s}" for s in sums])


def in_order(df: DataFrame, keys: Sequence[str], x: str, sums: Sequence[str] = ()) -> DataFrame:
    """Adds _r, _n and _c_<column>: places in the group, rows of the group and running sums."""
    out = placed(df, keys, x)
    return (running_sums(stored(out, "placed"), keys, x, sums) if sums else out).drop("_part")


def half_width(span: float, n: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(0.5 * span * n + 0.5))


def running_lines(df: DataFrame, keys: Sequence[str], x: str, weight: str, values: Sequence[str], spans: dict[str, float], leverage: bool = False) -> DataFrame:
    """Adds <value>_<span>, the weighted least-squares line through the window of each row, read at its x; with leverage also _h_<span>, the row's own part in it.

    A window is the share `span` of a group's rows around a row, moved inwards at the ends. Its sums are differences of
    two running sums: each row sends its own to the two rows that need them, one shuffle for all spans, and the windows
    at the ends come from a few rows a group. x should be centered. df is placed, and read several times.
    """
    terms = {"_w": F.col(weight), "_wx": F.col(weight) * F.col(x), "_wxx": F.col(weight) * F.col(x) * F.col(x)}
    for v in values:
        terms |= {f"_wy_{v}": F.col(weight) * F.col(v), f"_wxy_{v}": F.col(weight) * F.col(x) * F.col(v)}
    ordered = running_sums(df.withColumns(terms), keys, x, list(terms))
    ordered = stored(ordered.select(*keys, *[c for c in df.columns if c not in (*keys, "_r", "_n")], "_r", "_n", F.struct(*[F.col(f"_c_{t}").alias(t) for t in terms]).alias("_c")), "ordered")
    n, r = F.col("_n"), F.col("_r")
    own = F.struct(*[c for c in ordered.columns if c not in (*keys, "_r", "_c")])
    none, nowhere = F.lit(None).cast(own_type(ordered, keys)), F.lit(None).cast(ordered.schema["_c"].dataType)
    sent = [F.struct(r.alias("t"), F.lit("own").alias("tag"), own.alias("own"), nowhere.alias("c"))]
    edges = []
    for name, span in spans.items():
        half = half_width(span, n)
        inside = lambda t, half=half: (t > half) & (t <= n - half)
        for tag, t in ((f"hi_{name}", r - half), (f"lo_{name}", r + half + 1)):
            sent.append(F.when(inside(t), F.struct(t.alias("t"), F.lit(tag).alias("tag"), none.alias("own"), F.col("_c").alias("c"))))
        full = F.least(2 * half + 1, n)
        edges += [F.max(F.when(r == full, F.col("_c"))).alias(f"first_{name}"), F.max(F.when(r == n - full, F.col("_c"))).alias(f"last_{name}")]
    edges.append(F.max(F.when(r == n, F.col("_c"))).alias("all"))
    got = ordered.select(*keys, F.explode(F.array(*sent)).alias("_e")).where("_e is not null").select(*keys, F.col("_e.t").alias("_r"), "_e.tag", "_e.own", "_e.c")
    tags = [f"{side}_{name}" for name in spans for side in ("hi", "lo")]
    got = got.groupBy(*keys, "_r").agg(F.first("own", ignorenulls=True).alias("own"), *[F.max(F.when(F.col("tag") == t, F.col("c"))).alias(t) for t in tags])
    ends = ordered.groupBy(*keys).agg(*edges)
    got = met(got, ends, keys).select(*keys, "_r", "own.*", *tags, *[c for c in ends.columns if c not in keys])
    sums, lines = {}, {}
    for name, span in spans.items():
        half = half_width(span, n)
        full = F.least(2 * half + 1, n)
        for t in terms:
            ends_ = F.when((r <= half) | (full == n), F.col(f"first_{name}.{t}")).when(r > n - half, F.col(f"all.{t}") - F.coalesce(F.col(f"last_{name}.{t}"), F.lit(0.0)))
            sums[f"{t}_{name}"] = ends_.otherwise(F.col(f"hi_{name}.{t}") - F.coalesce(F.col(f"lo_{name}.{t}"), F.lit(0.0)))
        w, xx = F.col(f"_w_{name}"), F.col(f"_wxx_{name}")
        xm, spread = F.col(f"_xm_{name}"), F.col(f"_spread_{name}")
        lines[f"_xm_{name}"] = F.try_divide(F.col(f"_wx_{name}"), w)
        wide = spread > 1e-9 * F.abs(xx)
        for v in values:
            ym = F.try_divide(F.col(f"_wy_{v}_{name}"), w)
            slope = F.when(wide, (F.col(f"_wxy_{v}_{name}") - xm * F.col(f"_wy_{v}_{name}")) / spread).otherwise(0.0)
            lines[f"{v}_{name}"] = ym + slope * (F.col(x) - xm)
        if leverage:
            lines[f"_h_{name}"] = F.col(weight) * (F.try_divide(F.lit(1.0), w) + F.when(wide, (F.col(x) - xm) * (F.col(x) - xm) / spread).otherwise(0.0))
    kept = [c for c in df.columns if c not in (*keys, "_r", "_n")]
    got = got.select(*keys, "_r", "_n", *kept, *[c.alias(k) for k, c in sums.items()])
    got = got.withColumns({k: c for k, c in lines.items() if k.startswith("_xm_")})
    got = got.withColumns({f"_spread_{name}": F.col(f"_wxx_{name}") - F.col(f"_wx_{name}") * F.col(f"_xm_{name}") for name in spans})
    return got.select(*keys, "_r", *kept, "_n", *[c.alias(k) for k, c in lines.items() if not k.startswith("_xm_")])


def own_type(ordered: DataFrame, keys: Sequence[str]) -> str:
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in ordered.schema if f.name not in (*keys, "_r", "_c"))
    return f"struct<{fields}>"


def super_smoothed(df: DataFrame, x: str, y: str, groups: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(groups, x, w, y, smooth): the super-smoother of y on x in each group, a row for each distinct x with its weight and mean y.

    Three running lines take in 5, 20 and 50 % of a group's distinct x. Their residuals, each row left out of its own
    line, are smoothed; the line of the least residual is best at an x; the best spans are smoothed, the lines are
    interpolated between spans, and the result is smoothed once more. Groups of fewer than 40 distinct x have one line
    over 30 %. Rows with a null x or y, or no weight, play no part. Distances are counted in distinct x, so a frequent
    value is one point.
    """
    keys = list(groups)
    if {x, *keys} & {"w", "y", "smooth"}:
        raise ValueError("x and groups must not be named w, y or smooth")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    at = F.col(x).cast("double")
    points = df.where(at.isNotNull() & F.col(y).isNotNull() & (w > 0)).groupBy(*keys, at.alias(x)).agg(F.sum(w).alias("w"), (F.sum(w * F.col(y)) / F.sum(w)).alias("y"))
    points = stored(points, "points")
    middle = points.groupBy(*keys).agg(F.avg(x).alias("_middle"))
    points = stored(placed(met(points, middle, keys).withColumn("_from_middle", F.col(x) - F.col("_middle")).drop("_middle"), keys, "_from_middle"), "centered")
    kinds = {r[0] for r in points.select(F.col("_n") >= FEW).distinct().collect()}
    few = running_lines(points.where(F.col("_n") < FEW), keys, "_from_middle", "w", ["y"], {"f": FEW_SPAN}).select(*keys, x, "w", "y", F.col("y_f").alias("smooth"))
    if True not in kinds:
        return few
    many = points.where(F.col("_n") >= FEW)
    spans = {"t": TWEETER, "m": MIDRANGE, "l": WOOFER}
    lines = running_lines(many, keys, "_from_middle", "w", ["y"], spans, leverage=True)
    left_out = {f"_d{k}": F.abs(F.col("y") - F.col(f"y_{k}")) / F.greatest(1 - F.col(f"_h_{k}"), F.lit(1e-9)) for k in spans}
    lines = stored(lines.withColumns(left_out).drop(*[f"_h_{k}" for k in spans]), "lines")
    judged = running_lines(lines, keys, "_from_middle", "w", list(left_out), {"m": MIDRANGE})
    d = [F.col(f"_d{k}_m") for k in spans]
    best = F.when((d[0] <= d[1]) & (d[0] <= d[2]), TWEETER).when(d[1] <= d[2], MIDRANGE).otherwise(WOOFER)
    judged = stored(judged.withColumn("_best", best).select(*keys, x, "_from_middle", "_part", "_r", "_n", "w", "y", "y_t", "y_m", "y_l", "_best"), "judged")
    mixed = running_lines(judged, keys, "_from_middle", "w", ["_best"], {"m": MIDRANGE})
    span = F.greatest(F.lit(TWEETER), F.least(F.lit(WOOFER), F.col("_best_m")))
    up, down = (span - MIDRANGE) / (WOOFER - MIDRANGE), (MIDRANGE - span) / (MIDRANGE - TWEETER)
    value = F.when(span >= MIDRANGE, (1 - up) * F.col("y_m") + up * F.col("y_l")).otherwise((1 - down) * F.col("y_m") + down * F.col("y_t"))
    mixed = stored(mixed.withColumn("_mixed", value).select(*keys, x, "_from_middle", "_part", "_r", "_n", "w", "y", "_mixed"), "mixed")
    last = running_lines(mixed, keys, "_from_middle", "w", ["_mixed"], {"t": TWEETER})
    last = last.select(*keys, x, "w", "y", F.col("_mixed_t").alias("smooth"))
    return last.unionByName(few) if False in kinds else last


def lines_sql(source: str, keys: Sequence[str], values: Sequence[str], spans: dict[str, float], leverage: bool = False) -> str:
    """running_lines in SQL over (keys, _x, w, values, r, n), for checks."""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    columns = []
    for name, span in spans.items():
        half = f"greatest(2, CAST(floor(0.5 * {span}::DOUBLE * n + 0.5) AS BIGINT))"
        full = f"least(2 * {half} + 1, n)"
        lo = f"greatest(1, least(r - {half}, n - {full} + 1))"
        frame = f"OVER ({part}ORDER BY _x ROWS BETWEEN (r - {lo}) PRECEDING AND ({lo} + {full} - 1 - r) FOLLOWING)"
        sums = {k: f"sum({e}) {frame}" for k, e in ({"w": "w", "x": "w * _x", "xx": "w * _x * _x"} | {f"y{v}": f"w * {v}" for v in values} | {f"xy{v}": f"w * _x * {v}" for v in values}).items()}
        columns += [f"{e} AS s_{k}_{name}" for k, e in sums.items()]
    outer = []
    for name in spans:
        xm, spread = f"(s_x_{name} / s_w_{name})", f"(s_xx_{name} - s_x_{name} * s_x_{name} / s_w_{name})"
        wide = f"{spread} > 1e-9 * abs(s_xx_{name})"
        for v in values:
            ym = f"(s_y{v}_{name} / s_w_{name})"
            outer.append(f"{ym} + CASE WHEN {wide} THEN (s_xy{v}_{name} - s_w_{name} * {xm} * {ym}) / {spread} ELSE 0 END * (_x - {xm}) AS {v}_{name}")
        if leverage:
            outer.append(f"w * (1 / s_w_{name} + CASE WHEN {wide} THEN (_x - {xm}) * (_x - {xm}) / {spread} ELSE 0 END) AS h_{name}")
    return f"SELECT COLUMNS(lambda c: NOT starts_with(c, 's_')), {', '.join(outer)} FROM (SELECT *, {', '.join(columns)} FROM {source})"


def super_smoothed_sql(source: str, keys: Sequence[str], x: str, y: str, w: str) -> str:
    """CTEs that end in `smooth(keys, x, w, y, smooth)`: super_smoothed in SQL, for checks."""
    k = "".join(f"{c}, " for c in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    return f"""sm_p AS (SELECT {k}CAST({x} AS DOUBLE) AS {x}, sum(CAST({w} AS DOUBLE)) AS w, sum({w} * {y}::DOUBLE) / sum({w}) AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND {w} > 0 GROUP BY ALL),
sm_c AS (SELECT *, {x} - avg({x}) OVER ({part}) AS _x, row_number() OVER ({part} ORDER BY {x}) AS r, count(*) OVER ({part}) AS n FROM sm_p),
sm_f AS ({lines_sql('(SELECT * FROM sm_c WHERE n < 40)', keys, ['y'], {'f': FEW_SPAN})}),
sm_l AS ({lines_sql('(SELECT * FROM sm_c WHERE n >= 40)', keys, ['y'], {'t': TWEETER, 'm': MIDRANGE, 'l': WOOFER}, True)}),
sm_d AS (SELECT *, abs(y - y_t) / greatest(1 - h_t, 1e-9) AS dt, abs(y - y_m) / greatest(1 - h_m, 1e-9) AS dm, abs(y - y_l) / greatest(1 - h_l, 1e-9) AS dl FROM sm_l),
sm_j AS ({lines_sql('sm_d', keys, ['dt', 'dm', 'dl'], {'m': MIDRANGE})}),
sm_b AS (SELECT *, CASE WHEN dt_m <= dm_m AND dt_m <= dl_m THEN {TWEETER}::DOUBLE WHEN dm_m <= dl_m THEN {MIDRANGE}::DOUBLE ELSE {WOOFER}::DOUBLE END AS best FROM sm_j),
sm_s AS (SELECT *, greatest({TWEETER}, least({WOOFER}, best_m)) AS span FROM ({lines_sql('sm_b', keys, ['best'], {'m': MIDRANGE})})),
sm_m AS (SELECT *, CASE WHEN span >= {MIDRANGE} THEN y_m + (span - {MIDRANGE}) / {WOOFER - MIDRANGE} * (y_l - y_m) ELSE y_m + ({MIDRANGE} - span) / {MIDRANGE - TWEETER} * (y_t - y_m) END AS mixed FROM sm_s),
smooth AS (SELECT {k}{x}, w, y, mixed_t AS smooth FROM ({lines_sql('sm_m', keys, ['mixed'], {'t': TWEETER})}) UNION ALL SELECT {k}{x}, w, y, y_f FROM sm_f)"""
