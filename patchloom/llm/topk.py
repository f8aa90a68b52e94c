"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is summed up by the mean and the deviation of each of its segments, at a coarse and at
finer resolutions. By Cauchy and Schwarz a segment's inner product is at most length * mean * mean
plus the product of the deviations' norms, which bounds the score from above and so the distance
from below. Queries run over a shard's coarse statistics first; only what may still reach the k-th
best score known goes on to finer statistics and then to exact scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows, stored, table

SCALE = 256.0
RESOLUTIONS = (1, 4, 16)
SHARD_ROWS, BLOCK_QUERIES = 1 << 14, 1 << 11
SEEDS = 8  # times k: the rows of the highest bounds, whose exact scores give the first threshold


def scaled(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) with floor(256 * x) for each component; without null ids, null vectors and vectors with a component that is null or not finite."""
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vectors = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    ids.append(i)
                    vectors.append(np.floor(SCALE * x))
            yield rows(schema, ids, vectors)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, "id long, v array<double>")


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose inner products bound the vectors': for the data and for the queries."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    width = np.diff(edges).astype(float)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / width
    spread = np.sqrt(np.maximum(np.add.reduceat((x - np.repeat(mean, np.diff(edges), axis=1)) ** 2, edges[:-1], axis=1), 0))
    return np.hstack([mean, spread]), np.hstack([mean * width, spread])


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the ids and exact scores of its k best rows of data, ties to smaller ids; never the row of its own id."""
    order = np.argsort(ids, kind="stable")
    data, ids = data[order], ids[order]
    exact = data.shape[1] * np.abs(data).max(initial=0) * np.abs(queries).max(initial=0) < 2**53
    if not exact or not data.shape[1]:  # beyond whole doubles: plain integers, held within a long
        whole = [[int(c) for c in row] for row in data]
        for q, i in zip(queries, query_ids.tolist(), strict=True):
            own = [int(c) for c in q]
            scores = np.array([max(-(1 << 63), min((1 << 63) - 1, sum(map(int.__mul__, own, row)))) for row in whole], np.int64)
            best = np.argsort(np.array([-int(s) for s in scores], object), kind="stable") if len(scores) else np.zeros(0, int)
            best = best[ids[best] != i][:k]
            yield i, ids[best], scores[best]
        return
    levels = [(statistics(data, s)[0], statistics(queries, s)[1]) for s in RESOLUTIONS]
    slack = 1e-9 * (1 + np.sqrt((queries**2).sum(1)) * np.sqrt((data**2).sum(1).max(initial=0)))
    for j, i in enumerate(query_ids.tolist()):
        left = np.flatnonzero(ids != i)
        if len(left) > SEEDS * k:
            bound = levels[0][0][left] @ levels[0][1][j]
            seeds = left[np.argpartition(-bound, SEEDS * k)[: SEEDS * k]]
            least = np.partition(data[seeds] @ queries[j], -k)[-k]
            left = left[bound >= least - slack[j]]
            for stats, own in levels[1:]:
                left = left[stats[left] @ own[j] >= least - slack[j]]
                if len(left) > SEEDS * k:
                    finer = data[left[:: max(1, len(left) // (SEEDS * k))]] @ queries[j]
                    least = max(least, np.partition(finer, -k)[-k])
        scores = data[left] @ queries[j]
        best = np.argsort(-scores, kind="stable")[:k]
        yield i, ids[left[best]], scores[best].astype(np.int64)


def top_k(data: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k best rows for each query by the inner product of floor(256 * x).

    Every row but those with the query's id is a candidate, repeated rows each. A repeated query id
    is one query (the least of its vectors). Vectors meet only those of their own length. Ties go to
    the smaller id; fewer rows than k give fewer ranks. A score beyond a long is held at its end.
    """
    rows_ = stored(scaled(data, id_col, vector_col), "vectors")
    asked = stored(scaled(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")), "queries")
    shards, blocks = max(1, -(-rows_.count() // SHARD_ROWS)), max(1, -(-asked.count() // BLOCK_QUERIES))
    # every shard of rows meets every block of queries in one cell of bounded size
    left = asked.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)), "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
    right = rows_.withColumns({"shard": F.pmod(F.xxhash64("id", "v"), F.lit(shards)), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    cell = lambda df: df.select(F.col("block").cast("int").alias("block"), F.col("shard").cast("int").alias("shard"), F.size("v").alias("dim"), "id", "v").groupBy("block", "shard", "dim")
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t.column("id").to_numpy()
        flat = t.column("v").combine_chunks()
        flat = flat.flatten() if isinstance(flat, pa.ListArray | pa.LargeListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
        return flat.to_numpy(zero_copy_only=False).reshape(len(ids), -1), ids

    def meet(q: pa.Table, d: pa.Table) -> pa.Table:
        if not len(q) or not len(d):
            return schema.empty_table()
        (qs, qi), (ds, di) = matrix(q), matrix(d)
        found = list(search(qs, qi, ds, di, k))
        return pa.table([np.repeat([f[0] for f in found], [len(f[1]) for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])], schema=schema)

    partial = cell(left).cogroup(cell(right)).applyInArrow(meet, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
