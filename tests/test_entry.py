import builtins
import dis
import glob
import os
import types

import duckdb
import pytest

import __spark_entry__ as driver
from patchloom.plans import queries, registry


def test_names_and_sql_agree():
    queries = driver.queries()
    assert set(driver.oracle_sql()) <= set(queries) and len(registry.queries()) >= 50


@pytest.mark.parametrize("name", ["analyze_mean_by", "analyze_replicate_weights", "analyze_median_by", "validate_errors", "donor_draw", "knn_top_k", "interpolate_linear", "ntile_strata", "impute_predictors"])
def test_against_sql(spark, data_dir, name):
    db = duckdb.connect()
    for p in glob.glob(f"{data_dir}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = registry.queries()[name](spark, data_dir)
    cols = sorted(df.columns)
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    want = sorted(db.sql(registry.oracle_sql()[name]).select(*[f'"{c}"' for c in cols]).fetchall(), key=key)
    assert got == want


def names_used(code):
    yield from (i.argval for i in dis.get_instructions(code) if i.opname == "LOAD_GLOBAL")
    for inner in code.co_consts:
        if isinstance(inner, types.CodeType):
            yield from names_used(inner)


def test_queries_use_defined_names():
    known = set(vars(queries)) | set(vars(builtins))
    assert {name: set(names_used(f.__code__)) - known for name, f in queries.QUERIES.items() if set(names_used(f.__code__)) - known} == {}


ODD = {  # segment: (customer key, quantities of its order's lines); weights are 1 + key % 7
    "plain": [(1, [2.0]), (4, [3.5, 1.0]), (5, [8.0])], "one": [(3, [37.5])], "one of 1": [(2, [1.0])], "0 and 1": [(1, [1.0]), (2, [0.0]), (3, [1.0]), (5, [0.0, 1.0])],
    "constant": [(k, [1234.5]) for k in range(1, 12)], "zeros": [(k, [0.0]) for k in range(1, 6)], "far": [(7 * k, [1e8 + k % 5 * 0.25]) for k in range(1, 10)], None: [(1, [4.0]), (2, [9.0])],
    "nulls": [(1, [4.0, None]), (2, [None, None]), (3, [2.5, 7.0]), (4, [None]), (13, [8.0])], "one left": [(1, [5.0]), (2, [None])], "all null": [(1, [None]), (2, [None])],
    "negative": [(-3, [4.0]), (-6, [9.0]), (2, [7.0])], "weights of 0": [(-3, [4.0]), (1, [9.0])], "NaN": [(1, [float("nan")]), (2, [3.0])], "infinite": [(1, [float("inf")]), (2, [3.0])],
}


def test_weighted_variance_of_odd_groups(spark, data_dir, tmp_path):
    test_against_sql(spark, data_dir, "weighted_variance_by")
    rows = [(g, key, lines) for g, orders in ODD.items() for key, lines in orders]
    keyed = [(n, key + (70 * n if key > 0 else -70 * n), g, lines) for n, (g, key, lines) in enumerate(rows, 1)]
    tables = {
        "customer": ("c_custkey BIGINT, c_mktsegment VARCHAR, c_acctbal DOUBLE, c_nationkey INTEGER", [(c, g, 1.0, 0) for _, c, g, _ in keyed]),
        "orders": ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_orderpriority VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP", [(n, c, "F", "5-LOW", 1.0, "2020-01-01") for n, c, _, _ in keyed]),
        "lineitem": ("l_orderkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR", [(n, x, 1.0, 0.0, 0.0, "R") for n, _, _, lines in keyed for x in lines]),
        "nation": ("n_nationkey INTEGER, n_regionkey INTEGER", [(0, 0)]),
        "region": ("r_regionkey INTEGER, r_name VARCHAR", [(0, "ASIA")]),
    }
    db = duckdb.connect()
    for name, (columns, values) in tables.items():
        db.execute(f"CREATE TABLE {name} ({columns})")
        db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(values[0]))})", values)
        db.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    text = lambda rows: {r[0]: [str(x if x is None else x + 0.0) for x in r[1:]] for r in rows}
    got = text(registry.queries()["weighted_variance_by"](spark, str(tmp_path)).select("segment", "mean", "variance").collect())
    want = text(db.sql(registry.oracle_sql()["weighted_variance_by"]).select("segment", "mean", "variance").fetchall())
    assert got == want and len(got) == len(ODD) - 1 and got["one"] == ["37.5", "nan"]
