import math
import random

import duckdb

from patchloom.llm.topk import OP8_SQL, op8_topk, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string"


def brute(rows, asked, k):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, done = [], set()
    for i, q in sorted(ok):
        if i in asked and i not in done:
            done.add(i)
            scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in ok if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_query_and_sql(spark, data_dir):
    got = sorted(tuple(r) for r in op8_topk(spark, data_dir).collect())
    rows = spark.read.parquet(f"{data_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute([tuple(r) for r in rows], {r.vec_id for r in rows if r.vec_id % 50 == 0}, 5)
    assert got == want
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{data_dir}/embeddings.parquet'")
    assert sorted(db.sql(OP8_SQL).fetchall()) == want


def test_many_shapes(spark):
    import numpy as np

    from patchloom.llm.topk import search

    rng = np.random.default_rng(4)
    for n, d, spread in ((700, 64, 1.0), (500, 7, 0.01), (300, 20, 5.0), (3, 5, 1.0)):
        data = np.floor(256 * (rng.normal(size=(n, d)) * spread + rng.normal(size=(n, 1))))
        data[n // 3 : n // 2] = data[0]
        ids = rng.permutation(n)
        whole = {int(i): row for i, row in zip(ids, data.astype(np.int64).tolist())}
        for i, best, scores in search(data[:20], ids[:20], data, ids, 5):
            want = sorted((-sum(a * b for a, b in zip(whole[i], v)), j) for j, v in whole.items() if j != i)[:5]
            assert [(-int(s), int(j)) for s, j in zip(scores, best)] == want


def test_edges(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(40)]
    rows += [(40, None), (41, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (42, [float("nan")] * 6), (43, [float("inf")] * 6), (None, [9.0] * 6), (44, [1.0, 2.0]), (45, [3.0, 4.0]), (46, []), (47, [3e38] * 6), (48, [-3e38] * 6), (7, rows[7][1]), (49, [0.25] * 6), (50, [0.25] * 6)]
    rows = [(i, None if v is None else [None if x is None else struct(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)
    asked = {0, 7, 20, 44, 46, 47, 49}
    got = sorted(tuple(r) for r in top_k(df, df.where(df.vec_id.isin(*asked)), 3).collect())
    assert got == brute(rows, asked, 3)
    assert top_k(df.limit(0), df.limit(0)).collect() == []


def struct(x):
    import numpy as np

    return float(np.float32(x))
