"""The registered queries: each applies operators to the driver's tables, beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.functions.random import uniform
from patchloom.functions.stats import denormalize, normalize, signif_within
from patchloom.operators import encode, fusion, monotonic, neighbors, prepare, rank, sampling, validate
from patchloom.operators.analyze import analyze, bootstrap_variance, weighted_median
from patchloom.operators.curves import smooth_quantiles
from patchloom.operators.screen import impute_screen
from patchloom.operators.smooth import super_smoothed, super_smoothed_sql
from patchloom.plans.fixtures import IMP, LEVELS, MICRO, POOLED, POOLED_COLUMNS, SE, analyze_sql, bootstrap_sql, imputed, median_sql, t_sql, u_sql
from patchloom.sources import fsd
from patchloom.sources.scratch import scratch_path
from patchloom.sources.tables import micro, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*by, "N", "y", "level", "type", F.round("est", 4).alias("est"), F.round("se", 3).alias("se"), F.round(F.log("df"), 3).alias("log_df"), F.round("moe", 2).alias("moe"))


STATUS = [("drawn", v, kind, f"CASE WHEN drawn = '{v}' THEN 1 ELSE 0 END") for kind in ("proportion",) for v in LEVELS]


@query(analyze_sql([("x", None, "mean", "x")]))
def analyze_mean_overall(s: SparkSession, d: str) -> DataFrame:
    return rounded(analyze(imputed(s, d), mean=["x"], weight="weight", detail=True))


@query(analyze_sql([("x", None, "mean", "x")], ("region",)))
def analyze_mean_by(s: SparkSession, d: str) -> DataFrame:
    return rounded(analyze(imputed(s, d), mean=["x"], by=["region"], weight="weight", detail=True), ("region",))


@query(analyze_sql([("x", None, "mean", "x")], ("region", "segment")))
def analyze_mean_by2(s: SparkSession, d: str) -> DataFrame:
    return rounded(analyze(imputed(s, d), mean=["x"], by=["region", "segment"], weight="weight", detail=True), ("region", "segment"))


@query(analyze_sql([("x", None, "sum", "x")], ("segment",)))
def analyze_sum_by(s: SparkSession, d: str) -> DataFrame:
    return rounded(analyze(imputed(s, d), sum=["x"], by=["segment"], weight="weight", detail=True), ("segment",))


@query(analyze_sql(STATUS, ("region",)))
def analyze_proportion_by(s: SparkSession, d: str) -> DataFrame:
    return rounded(analyze(imputed(s, d), proportion={"drawn": LEVELS}, by=["region"], weight="weight", detail=True), ("region",))


@query(analyze_sql([(y, v, "count", e) for y, v, _, e in STATUS], ("region",)))
def analyze_count_by(s: SparkSession, d: str) -> DataFrame:
    return rounded(analyze(imputed(s, d), count={"drawn": LEVELS}, by=["region"], weight="weight", detail=True), ("region",))


@query(analyze_sql([("large", "true", "proportion", "CASE WHEN large THEN 1 ELSE 0 END")], ("priority",)))
def analyze_logical_proportion(s: SparkSession, d: str) -> DataFrame:
    return rounded(analyze(imputed(s, d), proportion={"large": [True]}, by=["priority"], weight="weight", detail=True), ("priority",))


@query(analyze_sql([("flag", None, "mean", "flag")], ("region",)))
def analyze_binary_variance(s: SparkSession, d: str) -> DataFrame:
    return rounded(analyze(imputed(s, d), mean=["flag"], by=["region"], weight="weight", detail=True), ("region",))


REP = "[" + ", ".join(f"floor(4 * weight * (0.5 + {u_sql(f'rep{k}', 'rid')}))" for k in range(1, 6)) + "][M]"


@query(analyze_sql([("x", None, "mean", "x")], ("region",), weight2=REP))
def analyze_replicate_weights(s: SparkSession, d: str) -> DataFrame:
    reps = {f"rep_{k}": F.floor(4 * F.col("weight") * (0.5 + uniform(f"rep{k}", "rid"))) for k in range(1, 6)}
    return rounded(analyze(imputed(s, d).withColumns(reps), mean=["x"], by=["region"], weight="weight", rep_weights=list(reps), detail=True), ("region",))


@query(analyze_sql([("per_line", None, "mean", "floor(x / n_lines)")], ("region",)))
def analyze_custom_fun(s: SparkSession, d: str) -> DataFrame:
    fun = lambda df: df.withColumn("per_line", F.floor(F.col("x") / F.col("n_lines")).cast("double"))
    return rounded(analyze(imputed(s, d), mean=["per_line"], by=["region"], weight="weight", fun=fun, detail=True), ("region",))


@query(analyze_sql([("x", None, "mean", "x"), ("x", None, "sum", "x"), *STATUS], ("region",)))
def analyze_multi(s: SparkSession, d: str) -> DataFrame:
    return rounded(analyze(imputed(s, d), mean=["x"], sum=["x"], proportion={"drawn": LEVELS}, by=["region"], weight="weight", detail=True), ("region",))


@query(analyze_sql([("x", None, "mean", "x")], ("region",)))
def analyze_static_join(s: SparkSession, d: str) -> DataFrame:
    whole = imputed(s, d)
    static = micro(s, d).select("rid", "region", "weight")
    return rounded(analyze(whole.select("rid", "M", "x"), mean=["x"], by=["region"], weight="weight", static=static, detail=True), ("region",))


MEDIAN = f"""WITH {IMP}, k AS (SELECT region, M, x, sum(weight) AS w FROM imp GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY region, M ORDER BY x) - w / 2.0 AS c, sum(w) OVER (PARTITION BY region, M) / 2.0 AS h FROM k),
e AS (SELECT region, M, any_value(h) AS h, max(x) FILTER (c <= h) AS x0, max(c) FILTER (c <= h) AS c0, min(x) FILTER (c > h) AS x1, min(c) FILTER (c > h) AS c1 FROM c GROUP BY ALL)
SELECT region, M, round(coalesce(x0 + (h - c0) / (c1 - c0) * (x1 - x0), x0, x1), 6) AS est FROM e"""


@query(MEDIAN)
def analyze_median_by(s: SparkSession, d: str) -> DataFrame:
    return weighted_median(imputed(s, d), ["region", "M"], "x", "weight").withColumn("est", F.round("est", 6))


@query(f"""WITH {IMP}, {bootstrap_sql('region, segment, M', 'imp')} SELECT region, segment, M, round(var, 4) AS var FROM boot""")
def analyze_median_bootstrap(s: SparkSession, d: str) -> DataFrame:
    return bootstrap_variance(imputed(s, d), ["region", "segment", "M"], "x", "weight").withColumn("var", F.round("var", 4))


DENSE = """sd AS (SELECT region, M, count(*) AS n, stddev_samp(x) AS sd, quantile_disc(x, 0.75) - quantile_disc(x, 0.25) AS iqr FROM imp GROUP BY ALL),
wd AS (SELECT *, 0.9 * CASE WHEN iqr > 0 THEN least(sd, iqr / 1.34) ELSE sd END * pow(n, -0.2) AS h FROM sd),
fd AS (SELECT region, M, any_value(n) AS n, sum(weight * exp(-pow((x - est) / h, 2) / 2)) / (sum(weight) * any_value(h) * 2.5066282746310002) AS f FROM imp JOIN wd USING (region, M) JOIN md USING (region, M) GROUP BY ALL)"""


@query(f"""WITH {IMP}, md AS ({median_sql('region, M', 'imp')}), {bootstrap_sql('region, M', 'imp')}, {DENSE},
t AS (SELECT region, M, n, est AS e1, coalesce(var, 1 / (4 * n * f * f)) AS v1 FROM md JOIN fd USING (region, M) LEFT JOIN boot USING (region, M)),
p AS (SELECT region, count(*) AS k, CAST(sum(n) / count(*) AS BIGINT) AS N, avg(e1) AS est, avg(v1) AS ub, var_samp(e1) AS b FROM t GROUP BY ALL), {POOLED}
SELECT region, N, 'x' AS y, NULL::VARCHAR AS level, 'median' AS type, {POOLED_COLUMNS}""")
def analyze_median_pooled(s: SparkSession, d: str) -> DataFrame:
    return rounded(analyze(imputed(s, d), median=["x"], by=["region"], weight="weight", detail=True), ("region",))


@query(f"WITH {IMP} SELECT rid, M, round({u_sql('fuse|qty', 'M', 'rid')}, 9) AS u, x, large, drawn FROM imp")
def implicates_expand(s: SparkSession, d: str) -> DataFrame:
    return imputed(s, d).select("rid", "M", F.round(uniform("fuse|qty", "M", "rid"), 9).alias("u"), "x", "large", "drawn")


@query(f"WITH {IMP} SELECT M, rid, x FROM imp WHERE M <= 2")
def read_fsd_project_m(s: SparkSession, d: str) -> DataFrame:
    path = fsd.write_implicates(imputed(s, d).select("rid", "M", "x", "drawn", "region"), scratch_path(s, "implicates"))
    return fsd.read_implicates(s, path, ["rid", "x"], m=2)


@query(f"WITH {IMP} SELECT M, rid, x, region FROM imp WHERE region IN (SELECT r_name FROM region WHERE r_regionkey < 2)")
def read_fsd_semi(s: SparkSession, d: str) -> DataFrame:
    path = fsd.write_implicates(imputed(s, d).select("rid", "M", "x", "drawn", "region"), scratch_path(s, "implicates"))
    match = table(s, d, "region").where("r_regionkey < 2").select(F.col("r_name").alias("region"))
    return fsd.read_implicates(s, path, ["rid", "x", "region"], m=None, match=match)


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_TYPE = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'DOUBLE[]' THEN 'array<double>' WHEN 'DATE' THEN 'date' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP_NS' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' ELSE lower(column_type) END"


@query(" UNION ALL ".join(f"SELECT '{t}' AS path, column_name AS var, {_TYPE} AS type FROM (DESCRIBE {t})" for t in TABLES))
def lookup_catalog(s: SparkSession, d: str) -> DataFrame:
    return fsd.catalog(s, d).withColumn("path", F.regexp_extract("path", r"([^/]*)\.parquet$", 1))


#: Data sets of several surveys and years, made of the tables.
SURVEYS = {"customer": "ACME_2015_2019_H_fused", "supplier": "ACME_2015_2020_P_fused", "nation": "GEO_2020_2019_P_custom", "part": "ITEMS_1998_core_2019_H_fused", "orders": "SALES_1998_2018_H_custom"}
_LOOKUP = " UNION ALL ".join(f"SELECT column_name AS var, '{n.split('_')[-3]}' AS acs_year, '{'Household' if n.split('_')[-2] == 'H' else 'Person'}' AS respondent, '{n.split('_')[0]}' AS survey, '{n.split('_')[1]}' AS vintage, '{n}' AS path FROM (DESCRIBE {t})" for t, n in SURVEYS.items())


@query(f"SELECT * FROM ({_LOOKUP}) WHERE acs_year IN ('2019', '2020') AND var IN ('c_nationkey', 's_nationkey', 'n_nationkey', 'n_name', 's_acctbal', 'p_brand', 'o_totalprice')")
def lookup_variables(s: SparkSession, d: str) -> DataFrame:
    root = scratch_path(s, "surveys")
    for t, n in SURVEYS.items():
        table(s, d, t).withColumns({"weight": F.lit(1), "rep_1": F.lit(2), "M": F.lit(1)}).write.parquet(f"{root}/{n}.parquet")
    found = fsd.lookup(s, root, ["c_nationkey", "s_nationkey", "n_nationkey", "n_name", "s_acctbal", "p_brand", "o_totalprice", "weight", "rep_1"], [2019, "2020"])
    return found.withColumn("path", F.regexp_extract("path", r"([^/]*)\.parquet$", 1))


@query(f"WITH {MICRO} " + " UNION ALL ".join(f"SELECT rid, 'status' AS y, '{v}' AS level, CASE WHEN status = '{v}' THEN 1 ELSE 0 END::INTEGER AS value FROM micro" for v in LEVELS))
def one_hot_status(s: SparkSession, d: str) -> DataFrame:
    return encode.one_hot(micro(s, d), "status", LEVELS, ["rid"])


@query("""WITH f AS (SELECT p_brand, sum(p_size) AS f FROM part GROUP BY 1), t AS (SELECT p_brand FROM f ORDER BY f DESC, p_brand LIMIT 4)
SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM t) THEN p_brand ELSE '_Other_' END AS p_brand FROM part""")
def lump_factor_brand(s: SparkSession, d: str) -> DataFrame:
    return encode.lump_levels(table(s, d, "part").select("p_partkey", "p_brand", "p_size"), "p_brand", 5, "p_size").select("p_partkey", "p_brand")


@query(f"WITH {MICRO} SELECT priority, sum(weight)::BIGINT AS freq FROM micro GROUP BY 1")
def weighted_table(s: SparkSession, d: str) -> DataFrame:
    return encode.weighted_table(micro(s, d), "priority", "weight")


@query(f"WITH {MICRO} SELECT rid, ntile(8) OVER (ORDER BY totalprice, rid)::INTEGER AS stratum FROM micro")
def ntile_strata(s: SparkSession, d: str) -> DataFrame:
    return sampling.strata(micro(s, d).select("rid", "totalprice"), "totalprice", 8, "rid").select("rid", "stratum")


@query(f"""WITH {MICRO}, r AS (SELECT rid, segment, row_number() OVER (PARTITION BY segment ORDER BY {u_sql('pick', 'rid')}, rid) AS k, count(*) OVER (PARTITION BY segment) AS n FROM micro)
SELECT rid, segment FROM r WHERE k <= round(0.2 * n)""")
def stratified_sample(s: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_sample(micro(s, d).select("rid", "segment"), "segment", 0.2, "pick", "rid")


@query(f"WITH {MICRO} SELECT rid, segment, ntile(5) OVER (PARTITION BY segment ORDER BY {u_sql('fold', 'rid')}, rid)::INTEGER AS fold FROM micro")
def kfold_assign(s: SparkSession, d: str) -> DataFrame:
    return sampling.k_folds(micro(s, d).select("rid", "segment"), "segment", 5, "fold", "rid")


@query(f"WITH {MICRO}, r AS (SELECT dense_rank() OVER (ORDER BY qty) AS a, dense_rank() OVER (ORDER BY n_lines) AS b, dense_rank() OVER (ORDER BY totalprice) AS c FROM micro) SELECT round(corr(a, b), 6) AS qty_lines, round(corr(a, c), 6) AS qty_price FROM r")
def dense_rank_corr(s: SparkSession, d: str) -> DataFrame:
    df = rank.ranked(micro(s, d).select("qty", "n_lines", "totalprice"), ["qty", "n_lines", "totalprice"], dense=["a", "b", "c"])
    return df.agg(F.round(F.corr("a", "b"), 6).alias("qty_lines"), F.round(F.corr("a", "c"), 6).alias("qty_price"))


_AVG = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in ("qty", "returned_value", "n_lines", "acctbal", "mon"))


@query(f"WITH {MICRO}, r AS (SELECT {_AVG} FROM micro) " + " UNION ALL ".join(f"SELECT '{y}' AS y, '{x}' AS x, round(corr(r_{y}, r_{x}), 6) AS r FROM r" for y in ("qty", "returned_value") for x in ("n_lines", "acctbal", "mon")))
def spearman_screen(s: SparkSession, d: str) -> DataFrame:
    return rank.spearman(micro(s, d), ["qty", "returned_value"], ["n_lines", "acctbal", "mon"]).withColumn("r", F.round("r", 6))


@query(f"WITH {MICRO}, t AS (SELECT segment FROM micro GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1) SELECT rid, (segment IN (SELECT segment FROM t))::INTEGER AS is_mode FROM micro")
def mode_indicator(s: SparkSession, d: str) -> DataFrame:
    return encode.mode_indicator(micro(s, d).select("rid", "segment"), "segment", "is_mode").select("rid", "is_mode")


@query(f"WITH {MICRO}, m AS (SELECT segment, median(qty) AS med FROM micro GROUP BY 1) SELECT segment, round(any_value(med), 6) AS center, round(median(abs(qty - med)) * 1.4826, 6) AS scale FROM micro JOIN m USING (segment) GROUP BY 1")
def median_mad_scale(s: SparkSession, d: str) -> DataFrame:
    df = micro(s, d).select("segment", "qty")
    med = df.groupBy("segment").agg(F.percentile("qty", 0.5).alias("med"))
    return df.join(med, "segment").groupBy("segment").agg(F.round(F.first("med"), 6).alias("center"), F.round(F.percentile(F.abs(F.col("qty") - F.col("med")), 0.5) * 1.4826, 6).alias("scale"))


_Q = 3.090232306167813


@query(f"WITH {MICRO} SELECT rid, round(((qty - 150) / 80 + {_Q}) / (2 * {_Q}), 9) AS z, round(qty, 6) AS back FROM micro")
def normalize_roundtrip(s: SparkSession, d: str) -> DataFrame:
    z = normalize(F.col("qty"), 150.0, 80.0)
    return micro(s, d).select("rid", F.round(z, 9).alias("z"), F.round(denormalize(z, 150.0, 80.0), 6).alias("back"))


_NA = f"SELECT rid, CASE WHEN {u_sql('na:qty', '0', 'rid')} < 0.2 THEN NULL ELSE qty END AS qty, CASE WHEN {u_sql('na:segment', '0', 'rid')} < 0.1 THEN NULL ELSE segment END AS segment FROM micro"


@query(f"""WITH {MICRO}, na AS ({_NA}), f AS (SELECT segment, count(*) AS n FROM na WHERE segment IS NOT NULL GROUP BY 1),
c AS (SELECT segment, sum(n) OVER (ORDER BY segment) / (SELECT sum(n) FROM f) AS hi, coalesce(lag(s) OVER (ORDER BY segment), 0) AS lo FROM (SELECT *, sum(n) OVER (ORDER BY segment) / (SELECT sum(n) FROM f) AS s FROM f))
SELECT rid, coalesce(qty, (SELECT median(qty) FROM na)) AS qty, coalesce(na.segment, (SELECT c.segment FROM c WHERE {u_sql('impute|segment', 'rid')} >= lo AND {u_sql('impute|segment', 'rid')} < hi)) AS segment FROM na""")
def impute_simple_median_mode(s: SparkSession, d: str) -> DataFrame:
    return encode.impute_simple(with_missing(s, d).select("rid", "qty", "segment"), ["qty"], ["segment"], "rid")


def with_missing(s: SparkSession, d: str) -> DataFrame:
    gone = lambda c, p: F.when(uniform(f"na:{c}", F.lit(0), "rid") >= p, F.col(c))
    return micro(s, d).withColumns({"qty": gone("qty", 0.2), "segment": gone("segment", 0.1)})


# validation over subsets of region, segment and status
VARS = ["region", "segment", "status"]
_SETS = "GROUPING SETS ((region), (segment), (status), (region, segment), (region, status), (segment, status))"
_SUBSET = "CASE grouping_id(region, segment, status) WHEN 3 THEN 'region' WHEN 5 THEN 'segment' WHEN 6 THEN 'status' WHEN 1 THEN 'region*segment' WHEN 2 THEN 'region*status' WHEN 4 THEN 'segment*status' END"


@query(f"WITH {MICRO} SELECT {_SUBSET} AS subset, region, segment, status, round(count(*) / (SELECT count(*) FROM micro), 9) AS share FROM micro GROUP BY {_SETS} HAVING count(*) >= 30")
def validate_subset_shares(s: SparkSession, d: str) -> DataFrame:
    df = micro(s, d).select(*VARS)
    return validate.subset_shares(df, VARS, df.count()).withColumn("share", F.round("share", 9))


def _agg(source: str, value: str, extra: str = "") -> str:
    sets = _SETS if not extra else "GROUPING SETS (" + ", ".join(f"({extra}, {g})" for g in ("region", "segment", "status", "region, segment", "region, status", "segment, status")) + ")"
    return f"SELECT {extra + ', ' if extra else ''}{_SUBSET} AS subset, region, segment, status, count(*) AS n, sum(weight) AS s, sum(weight * weight) AS ss, sum(weight * {value}) AS sv, sum(weight * weight * {value}) AS ssv, sum(weight * weight * {value} * {value}) AS ssvv FROM {source} GROUP BY {sets} HAVING count(*) >= 30"


_EST = "sv / s AS e, n / ((n - 1) * s::DOUBLE * s) * (ssvv - 2 * (sv / s) * ssv + (sv / s) * (sv / s) * ss) AS v"


@query(f"WITH {MICRO}, a AS ({_agg('micro', 'qty')}) SELECT subset, region, segment, status, 'qty' AS y, n, round(sv / s, 5) AS est_obs FROM a")
def validate_obs_est(s: SparkSession, d: str) -> DataFrame:
    got = validate.observed(micro(s, d), {"qty": None}, VARS, "weight")
    return got.select("subset", *VARS, "y", "n", F.round("est_obs", 5).alias("est_obs"))


@query(f"""WITH {IMP}, a AS (SELECT *, {_EST} FROM ({_agg('imp', 'x', 'M')})),
p AS (SELECT subset, region, segment, status, max(n) AS n, count(*) AS k, avg(e) AS est, avg(v) AS ub, var_samp(e) AS b FROM a GROUP BY subset, region, segment, status), {SE},
q AS (SELECT *, coalesce(df, n - 1) AS dn FROM se)
SELECT subset, region, segment, status, 'x' AS y, n, round(est, 5) AS est_sim, round(se * {t_sql(0.95, 'dn')}, 2) AS moe_sim FROM q""")
def validate_sim_est(s: SparkSession, d: str) -> DataFrame:
    got = validate.simulated(imputed(s, d), {"x": None}, VARS, "weight")
    return got.select("subset", *VARS, "y", "n", F.round("est_sim", 5).alias("est_sim"), F.round("moe_sim", 2).alias("moe_sim"))


@query(f"""WITH {IMP}, o AS (SELECT *, sv / s AS eo FROM ({_agg('micro', 'qty * 10')})), q AS (SELECT subset, region, segment, status, avg(sv / s) AS es FROM ({_agg('imp', 'x', 'M')}) GROUP BY ALL),
b AS (SELECT sum(weight * qty * 10) / sum(weight) AS m FROM micro)
SELECT o.subset, o.region, o.segment, o.status, round(abs(es - eo) / abs(eo), 6) AS err, round(greatest(0, 1 - abs(es - eo) / abs(m - eo)), 4) AS vad
FROM o JOIN q ON o.subset = q.subset AND o.region IS NOT DISTINCT FROM q.region AND o.segment IS NOT DISTINCT FROM q.segment AND o.status IS NOT DISTINCT FROM q.status, b""")
def validate_errors(s: SparkSession, d: str) -> DataFrame:
    got = validated(s, d)
    return got.select("subset", *VARS, F.round("err", 6).alias("err"), F.round("vad", 4).alias("vad"))


def validated(s: SparkSession, d: str) -> DataFrame:
    base = micro(s, d).withColumn("x", F.col("qty") * 10)
    obs = validate.observed(base, {"x": None}, VARS, "weight")
    sim = validate.simulated(imputed(s, d), {"x": None}, VARS, "weight")
    overall = base.agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("est_mean")).select(F.lit("x").alias("y"), F.lit(None).cast("string").alias("level"), "est_mean")
    return validate.compared(obs, sim, overall, VARS)


COMPARED = f"""a AS (SELECT *, {_EST} FROM ({_agg('imp', 'x', 'M')})), o AS (SELECT *, {_EST} FROM ({_agg('micro', 'qty * 10')})),
p AS (SELECT subset, region, segment, status, count(*) AS k, avg(e) AS est, avg(v) AS ub, var_samp(e) AS b FROM a GROUP BY subset, region, segment, status), {SE},
al AS (SELECT sum(weight * qty * 10) / sum(weight) AS m, count(*) AS total FROM micro),
pairs AS (SELECT o.n / total AS share, o.n - 1 AS d1, coalesce(df, o.n - 1) AS dn, o.e, o.v, est, se, m FROM o JOIN se ON o.subset = se.subset AND o.region IS NOT DISTINCT FROM se.region AND o.segment IS NOT DISTINCT FROM se.segment AND o.status IS NOT DISTINCT FROM se.status, al),
metrics AS (SELECT share, abs(est - e) / abs(e) AS err, greatest(0, 1 - abs(est - e) / abs(m - e)) AS vad, (se * {t_sql(0.95, 'dn')} / est) / (sqrt(v) * {t_sql(0.95, 'd1')} / e) AS moe_ratio FROM pairs),
long AS (SELECT share, unnest(['err', 'vad', 'moe_ratio']) AS metric, unnest([err, vad, moe_ratio]) AS value FROM metrics),
bins AS (SELECT metric, share, value, ntile(20) OVER (PARTITION BY metric ORDER BY share, value) AS k FROM long),
middle AS (SELECT metric, k, avg(share) AS share, median(value) AS m FROM bins GROUP BY ALL),
curve AS (SELECT metric, share, avg(m) OVER (PARTITION BY metric ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS value FROM middle)"""


@query(f"WITH {IMP}, {COMPARED} SELECT 'x' AS y, round(share, 9) AS share, round(value, 6) AS err FROM curve WHERE metric = 'err'")
def smooth_curve(s: SparkSession, d: str) -> DataFrame:
    got = validated(s, d).withColumn("share", F.col("n") / F.lit(micro(s, d).count()))
    return validate.smooth_curve(got, "y", "share", "err", 20).select("y", F.round("share", 9).alias("share"), F.round("err", 6).alias("err"))


@query(f"""WITH {IMP}, {COMPARED}, held AS (SELECT metric, share, least(greatest(value, lo), hi) AS value FROM curve JOIN (SELECT metric, min(value) AS lo, max(value) AS hi FROM long GROUP BY 1) USING (metric))
SELECT 'x' AS y, metric, round(share, 9) AS share, round(value, 5) AS value, round(avg(value) OVER (PARTITION BY metric), 5) AS mean FROM held""")
def validate_report(s: SparkSession, d: str) -> DataFrame:
    got = validate.report(validated(s, d), micro(s, d).count(), 20)
    kinds = list(validate.METRICS)
    means = got.means.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("mean")) for m in kinds])).alias("_m")).select("_m.*")
    return got.smooth.join(means, "metric").select("y", "metric", F.round("share", 9).alias("share"), F.round("value", 5).alias("value"), F.round("mean", 5).alias("mean"))


@query()
def subset_bins(s: SparkSession, d: str) -> DataFrame:
    base = micro(s, d)
    edges = validate.bin_edges(base, "acctbal")
    return validate.subset_shares(validate.binned(base, "acctbal", edges), ["acctbal", "region"], base.count())


# neighbours, draws
CENTERS = [(k, float(20 + 35 * k), float(1 + k * 1.5)) for k in range(8)]
_CENTERS = "centers(cid, cq, cn) AS (VALUES " + ", ".join(f"({k}::INTEGER, {q}::DOUBLE, {n}::DOUBLE)" for k, q, n in CENTERS) + ")"


def centers(s: SparkSession) -> DataFrame:
    return s.createDataFrame(CENTERS, "cid int, qty double, n_lines double")


@query(f"WITH {MICRO}, {_CENTERS}, p AS (SELECT cid, rid, (qty - cq) * (qty - cq) + (n_lines - cn) * (n_lines - cn) AS dist2 FROM micro, centers), r AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY dist2, rid)::INTEGER AS rank FROM p) SELECT cid, rid, dist2, rank FROM r WHERE rank <= 10")
def knn_top_k(s: SparkSession, d: str) -> DataFrame:
    return neighbors.top_k_donors(micro(s, d), centers(s), 10, "cid", "rid", ["qty", "n_lines"])


@query(f"WITH {MICRO}, {_CENTERS}, p AS (SELECT rid, cid, (qty - cq) * (qty - cq) + (n_lines - cn) * (n_lines - cn) AS dist2 FROM micro, centers) SELECT rid, cid, dist2 FROM p QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist2, cid) = 1")
def nearest_center(s: SparkSession, d: str) -> DataFrame:
    return neighbors.nearest_center(micro(s, d).select("rid", "qty", "n_lines"), centers(s), "cid", ["qty", "n_lines"]).select("rid", "cid", "dist2")


@query(f"""WITH {MICRO}, dn AS (SELECT *, sum(weight) OVER (PARTITION BY region ORDER BY rid)::DOUBLE AS hi FROM micro WHERE rid % 2 = 1), tot AS (SELECT region, sum(weight)::DOUBLE AS t FROM dn GROUP BY 1),
rc AS (SELECT m.rid, m.region, {u_sql('draw', 'm.rid')} * t AS at FROM micro m JOIN tot ON m.region = tot.region WHERE m.rid % 2 = 0)
SELECT rc.rid, rc.region, dn.rid AS donor_id, dn.qty, dn.totalprice FROM rc ASOF JOIN (SELECT *, hi - weight AS lo FROM dn) dn ON rc.region = dn.region AND rc.at >= dn.lo""")
def donor_draw(s: SparkSession, d: str) -> DataFrame:
    base = micro(s, d)
    donors = base.where("rid % 2 = 1").select("region", F.col("rid").alias("donor_id"), "weight", "qty", "totalprice")
    return sampling.donor_draw(base.where("rid % 2 = 0").select("rid", "region"), donors, "region", "weight", ["qty", "totalprice"], uniform("draw", "rid"), "rid", "donor_id")


@query(f"WITH {MICRO} SELECT rid, CASE WHEN {u_sql('cat', 'rid')} <= 0.05 * n_lines THEN 'F' WHEN {u_sql('cat', 'rid')} <= 0.05 * n_lines + 0.3 THEN 'O' ELSE 'P' END AS drawn FROM micro")
def categorical_draw(s: SparkSession, d: str) -> DataFrame:
    p = F.lit(0.05) * F.col("n_lines")
    return micro(s, d).select("rid", sampling.categorical_draw([p, F.lit(0.3), 0.7 - p], LEVELS, uniform("cat", "rid")).alias("drawn"))


@query(f"WITH {MICRO} SELECT rid, {u_sql('zero', 'rid')} < 1.0 / (1 + n_lines) AS is_zero FROM micro")
def zero_draw(s: SparkSession, d: str) -> DataFrame:
    return micro(s, d).select("rid", sampling.zero_draw(1.0 / (1 + F.col("n_lines")), uniform("zero", "rid")).alias("is_zero"))


_SPAN = 1.3489795003921634


@query(f"""WITH {MICRO}, {_CENTERS}, p AS (SELECT cid, cq, rid, qty, weight, (qty - cq) * (qty - cq) + (n_lines - cn) * (n_lines - cn) AS dist2 FROM micro, centers),
r AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY dist2, rid) AS rank FROM p QUALIFY rank <= 60),
c AS (SELECT *, sum(qty * weight) OVER w / sum(weight) OVER w AS m, sum(CASE WHEN qty <= cq - 20 THEN weight ELSE 0 END) OVER w / sum(weight) OVER w AS lo, sum(CASE WHEN qty <= cq + 20 THEN weight ELSE 0 END) OVER w / sum(weight) OVER w AS hi FROM r WINDOW w AS (PARTITION BY cid ORDER BY rank)),
e AS (SELECT cid, rank, 1 - exp(-power((m - cq) / (40 / {_SPAN}), 2) / 2) + abs(lo - 0.25) / 0.75 + abs(hi - 0.75) / 0.75 AS raw FROM c),
t AS (SELECT cid, rank, avg(raw) OVER (PARTITION BY cid ORDER BY rank ROWS 4 PRECEDING) AS err FROM e),
f AS (SELECT *, min(err) OVER (PARTITION BY cid) AS b FROM t WHERE rank >= 10)
SELECT cid, min(rank)::INTEGER AS k FROM f WHERE err <= greatest(b, 0.01) OR err <= greatest(1.05 * b, b + 0.005) GROUP BY cid""")
def optimal_k(s: SparkSession, d: str) -> DataFrame:
    base = micro(s, d)
    near = neighbors.top_k_donors(base, centers(s), 60, "cid", "rid", ["qty", "n_lines"])
    near = near.join(base.select("rid", "qty", "weight"), "rid").join(centers(s).select("cid", F.col("qty").alias("m")), "cid").withColumns({"lo": F.col("m") - 20, "hi": F.col("m") + 20})
    return neighbors.optimal_k(near, "cid", "qty", "weight", "m", "lo", "hi").select("cid", F.col("k").cast("int").alias("k"))


# monotonic pairs
@query("""WITH k AS (SELECT l_returnflag, ceil(l_quantity / 5) * 5 AS x, min(l_extendedprice) AS y FROM lineitem GROUP BY ALL),
q AS (SELECT DISTINCT l_returnflag, l_quantity AS x FROM lineitem),
b AS (SELECT q.*, lo.x AS x0, lo.y AS y0 FROM q ASOF LEFT JOIN k lo ON q.l_returnflag = lo.l_returnflag AND q.x >= lo.x),
c AS (SELECT b.*, hi.x AS x1, hi.y AS y1 FROM b ASOF LEFT JOIN k hi ON b.l_returnflag = hi.l_returnflag AND b.x <= hi.x)
SELECT l_returnflag, x, round(CASE WHEN x0 = x1 THEN y0 ELSE coalesce(y0 + (x - x0) / (x1 - x0) * (y1 - y0), y0, y1) END, 4) AS y_hat FROM c""")
def interpolate_linear(s: SparkSession, d: str) -> DataFrame:
    """The least price of each five quantities, interpolated at every quantity."""
    li = table(s, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    knots = li.groupBy("l_returnflag", (F.ceil(F.col("l_quantity") / 5) * 5).alias("x")).agg(F.min("l_extendedprice").alias("y"))
    asked = li.groupBy("l_returnflag", F.col("l_quantity").alias("x")).agg(F.concat_ws("|", "l_returnflag", F.col("l_quantity").cast("string")).alias("id"))
    got = monotonic.interpolated(asked, knots, ["l_returnflag"], "x", "y", "id")
    return got.select("l_returnflag", "x", F.round("y_hat", 4).alias("y_hat"))


@query(f"""WITH {MICRO}, r AS (SELECT segment, corr(qty, returned_value) AS r FROM micro GROUP BY 1), a AS (SELECT rid, segment, row_number() OVER (PARTITION BY segment ORDER BY qty, rid) AS k FROM micro),
b AS (SELECT m.segment, returned_value, row_number() OVER (PARTITION BY m.segment ORDER BY CASE WHEN r >= 0 THEN returned_value ELSE -returned_value END, rid) AS k FROM micro m JOIN r ON m.segment = r.segment)
SELECT rid, segment, round(returned_value, 2) AS y_mono FROM a JOIN b USING (segment, k)""")
def monotonic_rearrange(s: SparkSession, d: str) -> DataFrame:
    got = monotonic.rearranged(micro(s, d).select("rid", "segment", "qty", "returned_value"), "qty", "returned_value", ["segment"], "rid")
    return got.select("rid", "segment", F.round("y_mono", 2).alias("y_mono"))


@query(f"WITH {MICRO}, m AS (SELECT segment, min(returned_value) FILTER (returned_value > 0) AS lo FROM micro GROUP BY 1) SELECT rid, round(CASE WHEN n_lines - 1 = 0 THEN 0.0 WHEN returned_value = 0 THEN lo ELSE returned_value END, 2) AS y FROM micro JOIN m USING (segment)")
def expend_fixups(s: SparkSession, d: str) -> DataFrame:
    df = micro(s, d).select("rid", "segment", (F.col("n_lines") - 1).alias("x"), F.col("returned_value").alias("y"))
    return monotonic.expend_fixups(df, "x", "y", ["segment"]).select("rid", F.round("y", 2).alias("y"))


@query(f"WITH {MICRO}, {super_smoothed_sql('micro', ['segment'], 'qty', 'returned_value', 'weight')} SELECT segment, qty, round(smooth, 1) AS smooth FROM smooth")
def super_smoother(s: SparkSession, d: str) -> DataFrame:
    return super_smoothed(micro(s, d), "qty", "returned_value", ["segment"], "weight").select("segment", "qty", F.round("smooth", 1).alias("smooth"))


@query(f"""WITH {MICRO}, mn AS (SELECT segment, min(returned_value) FILTER (returned_value > 0) AS least, sum(returned_value * weight) AS total FROM micro GROUP BY 1),
fx AS (SELECT segment, qty AS ax, weight, CASE WHEN qty = 0 THEN 0 WHEN returned_value = 0 THEN least ELSE returned_value END AS yf FROM micro JOIN mn USING (segment)),
{super_smoothed_sql('fx', ['segment'], 'ax', 'yf', 'weight')}, c AS (SELECT segment, coalesce(corr(ax, smooth), 1) AS r0 FROM smooth GROUP BY 1),
xs AS (SELECT segment, ax, w, row_number() OVER (PARTITION BY segment ORDER BY ax) AS p FROM smooth),
vs AS (SELECT segment, smooth AS v, row_number() OVER (PARTITION BY segment ORDER BY CASE WHEN r0 >= 0 THEN smooth ELSE -smooth END) AS p FROM smooth JOIN c USING (segment)),
lo AS (SELECT segment, ax, w, least, total, CASE WHEN ax = 0 THEN 0 ELSE greatest(v, least) END AS m FROM xs JOIN vs USING (segment, p) JOIN mn USING (segment)),
sc AS (SELECT segment, any_value(total) / sum(m * w) AS scale FROM lo GROUP BY 1)
SELECT rid, round(CASE WHEN ax = 0 THEN 0 ELSE greatest(m * scale, least) END, 1) AS y_mono FROM micro JOIN lo ON micro.segment = lo.segment AND micro.qty = lo.ax JOIN sc ON sc.segment = lo.segment""")
def monotonic_fit(s: SparkSession, d: str) -> DataFrame:
    got = monotonic.monotonic(micro(s, d).select("rid", "segment", "qty", "returned_value", "weight"), "qty", "returned_value", "rid", ["segment"], "weight")
    return got.select("rid", F.round("y_mono", 1).alias("y_mono"))


@query()
def isotonic_fit(s: SparkSession, d: str) -> DataFrame:
    return monotonic.isotonic(micro(s, d).select("rid", "qty", "returned_value", F.col("weight").cast("double").alias("weight")), "qty", "returned_value", "weight")


# weighted spread, rounding, quantiles
@query(f"WITH {MICRO}, m AS (SELECT segment, sum(weight * qty) / sum(weight) AS m, count(*) / sum(weight) AS f FROM micro GROUP BY 1) SELECT segment, round(sqrt(sum(weight * f * (qty - m) * (qty - m)) / (count(*) - 1)), 5) AS wsd FROM micro JOIN m USING (segment) GROUP BY segment")
def wsd_by(s: SparkSession, d: str) -> DataFrame:
    w, x = F.col("weight").cast("double"), F.col("qty")
    sums = micro(s, d).groupBy("segment").agg(F.count("*").alias("n"), F.sum(w).alias("s"), F.sum(w * x).alias("sx"), F.sum(w * x * x).alias("sxx"))
    return sums.select("segment", F.round(F.sqrt((F.col("sxx") - F.col("sx") * F.col("sx") / F.col("s")) * F.col("n") / F.col("s") / (F.col("n") - 1)), 5).alias("wsd"))


@query(f"""WITH {MICRO}, g AS (SELECT segment, count(*) AS n, sum(weight) AS s, avg(weight) AS wb, sum(weight * qty) / sum(weight) AS m FROM micro GROUP BY 1)
SELECT segment, round(any_value(m), 6) AS mean, round(any_value(n / ((n - 1) * s::DOUBLE * s)) * (sum(power(weight * qty - wb * m, 2)) - 2 * any_value(m) * sum((weight - wb) * (weight * qty - wb * m)) + any_value(m) * any_value(m) * sum(power(weight - wb, 2))), 8) AS variance FROM micro JOIN g USING (segment) GROUP BY segment""")
def weighted_variance_by(s: SparkSession, d: str) -> DataFrame:
    """Cochran's variance of the weighted mean, with the sums of squares as central moments, which combine before the shuffle.

    As in the SQL, rows without qty (all but k) count in n and the weights, values of 0 and 1 have no formula of their own, and a divisor of 0 gives an infinite value or NaN.
    """
    x, w = F.col("qty"), F.col("weight").cast("double")
    sums = [F.count("*").alias("n"), F.sum(w).alias("s"), F.avg(w).alias("wb"), F.sum(w * x).alias("sx"), F.var_pop(w).alias("ww")]
    sums += [F.count(x).alias("k"), F.avg(w * x).alias("p"), F.avg(F.when(x.isNotNull(), w)).alias("wk"), F.var_pop(w * x).alias("pp"), F.covar_pop(w, w * x).alias("wp")]
    divided = lambda a, b: f"CASE WHEN {b} = 0 THEN {a} * double('Infinity') ELSE try_divide({a}, {b}) END"
    parts = micro(s, d).where("segment IS NOT NULL").groupBy("segment").agg(*sums).withColumn("m", F.expr(divided("sx", "s"))).withColumn("c", F.expr("wb * m"))
    squares = F.expr("k * (pp + (p - c) * (p - c)) - 2 * m * k * (wp + (wk - wb) * (p - c)) + m * m * n * ww")
    return parts.select("segment", F.round("m", 6).alias("mean"), F.round(F.expr(divided("n", "((n - 1) * s * s)")) * squares, 8).alias("variance"))


_AT = lambda k: f"round(totalprice / pow(10.0, floor(log10(abs(totalprice))) - {k - 1})) * pow(10.0, floor(log10(abs(totalprice))) - {k - 1})"
_FEWEST = ", ".join(f"CASE WHEN totalprice <> 0 AND abs({_AT(k)} - totalprice) <= 0.001 * abs(totalprice) THEN {_AT(k)} END" for k in range(1, 15))


@query(f"WITH {MICRO} SELECT rid, round(coalesce({_FEWEST}, totalprice), 4) AS price FROM micro")
def signif_digits(s: SparkSession, d: str) -> DataFrame:
    return micro(s, d).select("rid", F.round(signif_within(F.col("totalprice"), 0.001), 4).alias("price"))


@query(f"WITH {MICRO} SELECT segment, quantile_disc(qty, 0.25) AS q25, quantile_disc(qty, 0.5) AS q50, quantile_disc(qty, 0.9) AS q90 FROM micro GROUP BY 1")
def quantile_type1(s: SparkSession, d: str) -> DataFrame:
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY qty)")
    return micro(s, d).groupBy("segment").agg(q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.9).alias("q90"))


# fusion: odd rows are donors, even rows recipients
X = ["segment", "priority", "region", "acctbal", "n_lines", "mon"]


def fused(s: SparkSession, d: str, y: list, m: int = 2) -> DataFrame:
    base = micro(s, d)
    model = fusion.DonorFusion(y, X, "rid", "weight").fit(base.where("rid % 2 = 1"))
    return model.transform(base.where("rid % 2 = 0"), m)


@query()
def train_fuse_continuous(s: SparkSession, d: str) -> DataFrame:
    return fused(s, d, ["qty"])


@query()
def train_grid_tuned(s: SparkSession, d: str) -> DataFrame:
    """The table of a grid: depths and rates by two folds, boosting that stops early."""
    hyper = {"max_depth": [2, 5], "learning_rate": [0.1, 0.4], "num_iterations": 24}
    model = fusion.DonorFusion(["qty"], X, "rid", "weight", nclusters=100, nfolds=2, hyper=hyper).fit(micro(s, d).where("rid % 2 = 1"))
    return model.tuning().withColumn("loss", F.round("loss", 6))


@query()
def train_fuse_block(s: SparkSession, d: str) -> DataFrame:
    return fused(s, d, [["disc_share", "tax_share"]])


@query()
def train_fuse_categorical(s: SparkSession, d: str) -> DataFrame:
    return fused(s, d, ["status", "is_large"])


@query()
def train_fuse_zero_inflated(s: SparkSession, d: str) -> DataFrame:
    return fused(s, d, ["returned_value"])


@query()
def importance_summary(s: SparkSession, d: str) -> DataFrame:
    model = fusion.DonorFusion(["status", "is_large"], X, "rid", "weight").fit(micro(s, d).where("rid % 2 = 1"))
    return model.importance()[0]


@query()
def impute_fusion(s: SparkSession, d: str) -> DataFrame:
    return fusion.impute_by_fusion(with_missing(s, d).select("rid", "qty", "segment", "region", "n_lines", "acctbal"), "rid")


SCREENED = {c: f"CASE WHEN {c} IS NOT NULL THEN dense_rank() OVER (ORDER BY {c} NULLS LAST) END" for c in ("qty", "acctbal", "n_lines", "mon", "totalprice", "returned_value")} | {"is_large": "CAST(is_large AS INTEGER)"}
SCREENED |= {c: f"CAST({c} = (SELECT {c} FROM na WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS INTEGER)" for c in ("segment", "region", "status", "priority")}
_SCREEN = f"""na AS (SELECT * REPLACE (CASE WHEN {u_sql('na:qty', '0', 'rid')} < 0.2 THEN NULL ELSE qty END AS qty, CASE WHEN {u_sql('na:segment', '0', 'rid')} < 0.1 THEN NULL ELSE segment END AS segment) FROM micro),
codes AS (SELECT {', '.join(f'{e} AS {c}' for c, e in SCREENED.items())} FROM na), full_ AS (SELECT {', '.join(f'coalesce({c}, (SELECT median({c}) FROM codes)) AS {c}' for c in SCREENED)} FROM codes),
pairs AS ({' UNION ALL '.join(f"SELECT '{y}' AS y, '{x}' AS x, coalesce(corr({y}, {x}), 0) AS r FROM full_" for y in ('segment', 'qty') for x in SCREENED if x != y)}),
best AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY abs(r) DESC, x) AS k, count(*) FILTER (abs(r) > 0.025) OVER (PARTITION BY y) AS n FROM pairs)"""


@query(f"WITH {MICRO}, {_SCREEN} SELECT y, x, round(r, 6) AS r FROM best WHERE k <= CASE WHEN least(n, 30) < 5 THEN 5 ELSE least(n, 30) END")
def impute_predictors(s: SparkSession, d: str) -> DataFrame:
    return impute_screen(with_missing(s, d), ["segment", "qty"], list(SCREENED)).withColumn("r", F.round("r", 6))


@query()
def quantile_curves(s: SparkSession, d: str) -> DataFrame:
    return smooth_quantiles(micro(s, d), "qty", "totalprice", [0.1, 0.5, 0.9], ["region"])


@query()
def quantile_spread(s: SparkSession, d: str) -> DataFrame:
    return smooth_quantiles(micro(s, d), "acctbal", "returned_value", "mad")


@query()
def prepxy_order(s: SparkSession, d: str) -> DataFrame:
    y = ["qty", "returned_value", "totalprice", "status", "is_large", ["disc_share", "tax_share"]]
    order, predictors = prepare.prepare(micro(s, d), y, ["acctbal", "n_lines", "mon", "region", "segment", "priority"], "weight", xforce=["region"])
    return s.createDataFrame([(k, t, ",".join(predictors[t])) for k, b in enumerate(order) for t in ([b] if isinstance(b, str) else b)], "place int, y string, x string")
