"""What the registered queries share: simulated implicates over the survey view, and the same in SQL."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.functions.random import uniform
from patchloom.operators.sampling import categorical_draw, implicates
from patchloom.sources.tables import micro

IMPLICATES = 5
LEVELS = ("F", "O", "P")

MICRO = """li AS (
  SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty,
    sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0.0 END) AS returned_value
  FROM lineitem GROUP BY l_orderkey
), micro AS (
  SELECT o_orderkey AS rid, c_mktsegment AS segment, o_orderpriority AS priority, r_name AS region, c_acctbal AS acctbal, n_lines,
    month(o_orderdate)::INTEGER AS mon, o_orderstatus AS status, o_totalprice AS totalprice, qty, returned_value, o_totalprice > 250000 AS is_large, 1 + o_custkey % 7 AS weight
  FROM orders JOIN li ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def u_sql(tag: str, *keys: str) -> str:
    text = " || '|' || ".join([f"'{tag}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


IMP = f"""{MICRO}, imp0 AS (SELECT micro.*, M::INTEGER AS M FROM micro, range(1, {IMPLICATES + 1}) t(M)),
imp AS (
  SELECT *, floor(qty * (8 + 4 * {u_sql('fuse|qty', 'M', 'rid')})) AS x, {u_sql('large', 'M', 'rid')} < 0.5 AS large,
    CASE WHEN {u_sql('status', 'M', 'rid')} <= 0.45 THEN 'F' WHEN {u_sql('status', 'M', 'rid')} <= 0.45 + 0.45 THEN 'O' ELSE 'P' END AS drawn,
    CASE WHEN {u_sql('flag', 'M', 'rid')} < 0.3 THEN 1.0 ELSE 0.0 END AS flag
  FROM imp0
)"""


def imputed(spark: SparkSession, sf_dir: str, m: int = IMPLICATES) -> DataFrame:
    """m implicates with simulated columns of each type: x (number), large (logical), drawn (category), flag (0 or 1)."""
    u = lambda tag: uniform(tag, "M", "rid")
    base = implicates(micro(spark, sf_dir).drop("disc_share", "tax_share"), m)
    return base.withColumns({"x": F.floor(F.col("qty") * (8 + 4 * u("fuse|qty"))).cast("double"), "large": u("large") < 0.5, "drawn": categorical_draw([F.lit(0.45), F.lit(0.45), F.lit(0.1)], LEVELS, u("status")), "flag": F.when(u("flag") < 0.3, 1.0).otherwise(0.0)})


def t_sql(p: float, df: str) -> str:
    """Hill's expansion of Student's t quantile (Comm. ACM 13, 1970) in SQL, for df not below 3; null df is infinite."""
    z, tail = NormalDist().inv_cdf(p), 2 * (1 - p)
    x, y1 = -z, z * z
    a = f"(1 / ({df} - 0.5))"
    b = f"(48 / ({a} * {a}))"
    c = f"(((20700 * {a} / {b} - 98) * {a} - 16) * {a} + 96.36)"
    d = f"(((94.5 / ({b} + {c}) - 3) / {b} + 1) * sqrt({a} * pi() / 2) * {df})"
    y0 = f"pow({d} * {tail!r}, 2 / {df})"
    c1 = f"({c} + CASE WHEN {df} < 5 THEN 0.3 * ({df} - 4.5) * ({x + 0.6!r}) ELSE 0 END)"
    c2 = f"((((0.05 * {d} * ({x!r}) - 5) * ({x!r}) - 7) * ({x!r}) - 2) * ({x!r}) + {b} + {c1})"
    y2 = f"((({((0.4 * y1 + 6.3) * y1 + 36) * y1 + 94.5!r} / {c2} - {y1!r} - 3) / {b} + 1) * ({x!r}))"
    near = f"(exp({a} * {y2} * {y2}) - 1)"
    far = f"(((1 / ((({df} + 6) / ({df} * {y0}) - 0.089 * {d} - 0.822) * ({df} + 2) * 3) + 0.5 / ({df} + 4)) * {y0} - 1) * ({df} + 1) / ({df} + 2) + 1 / {y0})"
    return f"CASE WHEN {df} IS NULL OR {df} > 1e10 THEN {z!r} ELSE sqrt({df} * CASE WHEN {y0} > 0.05 + {a} THEN {near} ELSE {far} END) END"


#: From pooled estimates p(est, ub, b, k): Rubin's standard error and degrees of freedom, and Student's quantile for each.
SE = "se AS (SELECT *, sqrt(ub + (1 + 1.0 / k) * b) AS se, CASE WHEN b = 0 THEN NULL WHEN ub = 0 THEN k - 1 ELSE (k - 1) * pow(1 + ub / ((1 + 1.0 / k) * b), 2) END AS df FROM p)"
POOLED = f"{SE}, tq AS (SELECT df AS df_, {t_sql(0.95, 'df')} AS t FROM (SELECT DISTINCT df FROM se))"
POOLED_COLUMNS = "round(est, 4) AS est, round(se, 3) AS se, round(ln(df), 3) AS log_df, round(se * t, 2) AS moe FROM se JOIN tq ON df IS NOT DISTINCT FROM df_"


def analyze_sql(items: list[tuple[str, str | None, str, str]], by: tuple[str, ...] = (), weight: str = "weight", weight2: str | None = None, var_scale: float = 4.0) -> str:
    """The pooled estimates of (y, level, type, expression) items in plain SQL."""
    groups = "".join(f"{b}, " for b in by)
    long = " UNION ALL ".join(f"SELECT M, {groups}CAST({weight} AS DOUBLE) AS w, CAST({weight2 or weight} AS DOUBLE) AS w2, '{y}' AS y, {'CAST(NULL AS VARCHAR)' if level is None else repr(level)} AS level, '{kind}' AS type, CAST({expression} AS DOUBLE) AS v FROM imp" for y, level, kind, expression in items)
    return f"""WITH {IMP}, long AS ({long}),
    a AS (SELECT M, {groups}y, level, type, count(*) AS n, sum(w) AS s, sum(w * w) AS ss, sum(w * v) AS sv, sum(w * w * v) AS ssv, sum(w * w * v * v) AS ssvv, sum(w2) AS s2, sum(w2 * v) AS s2v, max(CASE WHEN v NOT IN (0, 1) THEN 1 ELSE 0 END) AS wide FROM long GROUP BY ALL),
    e AS (SELECT *, sv / s AS e1, s2v / s2 AS e2, CASE WHEN wide = 0 THEN sv / s * (1 - sv / s) * ss / (s * s) ELSE n / ((n - 1) * s * s) * (ssvv - 2 * (sv / s) * ssv + (sv / s) * (sv / s) * ss) END AS v1 FROM a),
    t AS (SELECT M, {groups}y, level, type, n, CASE WHEN type IN ('sum', 'count') THEN e1 * s ELSE e1 END AS e1, CASE WHEN type IN ('sum', 'count') THEN e2 * s2 ELSE e2 END AS e2, CASE WHEN type IN ('sum', 'count') THEN v1 * s * s ELSE v1 END AS v1 FROM e),
    p AS (SELECT {groups}y, level, type, count(*) AS k, CAST(sum(n) / count(*) AS BIGINT) AS N, avg(e1) AS est, avg(v1) AS ub, var_samp(e1) + {f'greatest(0, var_samp(e2) - var_samp(e1)) * {var_scale} * (count(*) - 1) / count(*)' if weight2 else '0'} AS b FROM t GROUP BY ALL),
    {POOLED}
    SELECT {groups}N, y, level, type, {POOLED_COLUMNS}"""


def median_sql(groups: str, source: str, x: str = "x", w: str = "weight") -> str:
    """(groups, est): the interpolated weighted medians of a source in SQL."""
    return f"""SELECT {groups}, coalesce(x0 + (h - c0) / (c1 - c0) * (x1 - x0), x0, x1) AS est FROM (
      SELECT {groups}, any_value(h) AS h, max(x) FILTER (c <= h) AS x0, max(c) FILTER (c <= h) AS c0, min(x) FILTER (c > h) AS x1, min(c) FILTER (c > h) AS c1 FROM (
        SELECT {groups}, x, sum(w) OVER (PARTITION BY {groups} ORDER BY x) - w / 2.0 AS c, sum(w) OVER (PARTITION BY {groups}) / 2.0 AS h FROM (
          SELECT {groups}, {x} AS x, sum({w}) AS w FROM {source} GROUP BY ALL)) GROUP BY ALL)"""


def bootstrap_sql(groups: str, source: str, draws: int = 200, most: int = 1000) -> str:
    """CTEs that end in boot(groups, var): the variances of the medians of groups of up to `most` rows over keyed resamples."""
    same = " AND ".join(f"r.{g.strip()} = v.{g.strip()}" for g in groups.split(","))
    own = ", ".join(f"r.{g.strip()}" for g in groups.split(","))
    return f"""boot_r AS (SELECT {groups}, x, weight, row_number() OVER (PARTITION BY {groups} ORDER BY x, weight) AS i, count(*) OVER (PARTITION BY {groups}) AS n FROM {source}),
boot_u AS (SELECT bt, bi, {u_sql('boot', 'bt', 'bi')} AS u FROM range(1, {draws + 1}) a(bt), range(1, {most + 1}) b(bi)),
boot_d AS (SELECT {own}, bt, v.x, r.weight FROM boot_r r JOIN boot_u ON bi = r.i JOIN boot_r v ON {same} AND v.i = CAST(floor(u * r.n) AS BIGINT) + 1 WHERE r.n <= {most}),
boot AS (SELECT {groups}, var_samp(est) AS var FROM ({median_sql(groups + ', bt', 'boot_d')}) GROUP BY ALL)"""
