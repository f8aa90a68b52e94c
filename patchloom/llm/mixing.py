"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents, shuffled by a keyed hash, form a stream of words that is read round and
round and cut into equal blocks. Golden-ratio points, mapped through the cumulative weights, name
the source of each slot; the r-th slot of a source takes the r-th block of its stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows, stored, table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK_WORDS = 64
#: Slots that every source gets beyond its need at first; where the points give a source fewer than it needs, twice as many.
SPARE_SLOTS = 8
SLOTS_PER_CHUNK = 1 << 16
ROWS_PER_BUCKET = 1 << 11
WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949


def targets(sizes: list[int], weights: list[float], most: float = MAX_REPEATS) -> list[float]:
    """The sum of sizes shared by weight; who would pass most * size stops there, and the rest is shared anew."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / total for i in open_}
        full = [i for i in sorted(open_) if share[i] > most * sizes[i]]
        if not full:
            for i, x in share.items():
                out[i] = x
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
            open_.remove(i)
    return out


@dataclass
class Mix:
    """rows: (row, id, source, size, source_size, target) for every document. taken: (row, taken).
    schedule: (slot, source_no, block, row, cycle, first_word, words), a row for each part of a document in a slot."""

    rows: DataFrame
    taken: DataFrame
    schedule: DataFrame


def points(chunks: Iterator[pa.RecordBatch], bounds: np.ndarray, slots: int, counts_only: bool) -> Iterator[pa.RecordBatch]:
    """The source of each slot of each chunk of slots, with its rank in the chunk; or the counts of sources."""
    fine = GOLDEN * SLOTS_PER_CHUNK % 1.0
    for batch in chunks:
        for chunk in batch.column(0).to_pylist():
            at = np.arange(chunk * SLOTS_PER_CHUNK, min(slots, (chunk + 1) * SLOTS_PER_CHUNK), dtype=np.int64)
            u = (chunk * fine % 1.0 + np.arange(len(at)) * GOLDEN + 0.5) % 1.0
            source = np.minimum(np.searchsorted(bounds, u, "right"), len(bounds) - 1)
            count = np.bincount(source, minlength=len(bounds))
            if counts_only:
                used = np.flatnonzero(count)
                yield rows(pa.schema([("chunk", pa.int64()), ("source_no", pa.int32()), ("held", pa.int64())]), np.full(len(used), chunk), used, count[used])
                continue
            order = np.argsort(source, kind="stable")
            rank = np.empty(len(at), np.int64)
            rank[order] = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            yield rows(pa.schema([("chunk", pa.int64()), ("source_no", pa.int32()), ("slot", pa.int64()), ("rank", pa.int64())]), np.full(len(at), chunk), source, at, rank)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, seed: int = 17, block_words: int = BLOCK_WORDS, row: str | None = None) -> Mix:
    """Mixes all documents. A document's size is its number of words; null and empty texts have 0.

    Sources in order of code points, null last and a source like others, take the weights in turn.
    A source's quota is its target, rounded; its stream ends there, so no document is read more than
    three times. Documents without words, and all if there are none, are taken 0 times. Repeated
    rows are documents of their own. row names a column of unique longs, if docs has one. The list
    of sources (not of documents) must fit the driver.
    """
    spark = docs.sparkSession
    key = F.col(row) if row else F.monotonically_increasing_id()
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = stored(docs.select(key.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"), F.xxhash64(text_col).alias("text_hash")), "sizes")
    held = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    held.sort(key=lambda r: (r.source is None, r.source or ""))
    goal = targets([r["size"] for r in held], [weights[i % len(weights)] for i in range(len(held))])
    quotas = [min(round(t), MAX_REPEATS * r["size"]) for t, r in zip(goal, held, strict=True)]
    plan = spark.createDataFrame([(i, r.source, r["size"], t, q) for i, (r, t, q) in enumerate(zip(held, goal, quotas, strict=True))], "source_no int, source string, source_size long, target double, quota long")
    known = sized.join(plan, sized.source.eqNullSafe(plan.source)).drop(plan.source)

    # places in the shuffled stream: buckets by hash, then prefix sums over buckets and in them
    buckets = max(1, -(-sum(r.n for r in held) // ROWS_PER_BUCKET))
    shuffle = F.xxhash64(F.lit(seed), F.col("id"), F.col("size"), F.col("text_hash"))
    placed = known.withColumns({"hash": shuffle, "bucket": F.pmod(shuffle, F.lit(buckets))})
    sums = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    earlier = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("words").over(earlier("bucket").partitionBy("source_no")), F.lit(0)).alias("before"))
    inside = earlier("hash", "id", "size", "row").partitionBy("source_no", "bucket")
    placed = placed.where("size > 0").join(sums, ["source_no", "bucket"]).withColumn("first", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))

    # what each document gives to each block of the stream, which is read in cycles up to the quota
    cycles = placed.where("quota > 0").withColumn("cycle", F.explode(F.expr("sequence(0L, (quota - 1) div source_size)")))
    cycles = cycles.withColumn("lo", F.expr("cycle * source_size + first")).where("lo < quota").withColumn("hi", F.expr("least(lo + size, quota)"))
    given = cycles.withColumn("block", F.explode(F.expr(f"sequence(lo div {block_words}, (hi - 1) div {block_words})")))
    given = given.select("source_no", "block", "row", "cycle", F.expr(f"greatest(lo, block * {block_words}) - lo").alias("first_word"), F.expr(f"least(hi, (block + 1) * {block_words}) - greatest(lo, block * {block_words})").alias("words"))

    need = [-(-q // block_words) for q in quotas]
    spare = SPARE_SLOTS
    while any(need):
        shares = np.array([n + spare if n else 0 for n in need], float)
        slots, bounds = int(shares.sum()), np.cumsum(shares) / shares.sum()
        chunks = spark.range(-(-slots // SLOTS_PER_CHUNK))
        counts = stored(chunks.mapInArrow(lambda b, bounds=bounds, slots=slots: points(b, bounds, slots, True), "chunk long, source_no int, held long"), "slots")
        drawn = {r.source_no: r.n for r in counts.groupBy("source_no").agg(F.sum("held").alias("n")).collect()}  # a row for each source
        if all(drawn.get(i, 0) >= n for i, n in enumerate(need)):
            break
        spare *= 2
    if any(need):
        counts = counts.select("chunk", "source_no", F.coalesce(F.sum("held").over(earlier("chunk").partitionBy("source_no")), F.lit(0)).alias("before"))
        drawn = chunks.mapInArrow(lambda b: points(b, bounds, slots, False), "chunk long, source_no int, slot long, rank long")
        # merge: Spark takes these tables for small, but they grow with the words
        drawn = drawn.hint("merge").join(counts, ["chunk", "source_no"]).select("source_no", "slot", (F.col("before") + F.col("rank")).alias("block"))
    else:
        drawn = spark.createDataFrame([], "source_no int, slot long, block long")
    schedule = drawn.hint("merge").join(given, ["source_no", "block"]).select("slot", "source_no", "block", "row", "cycle", "first_word", "words")
    taken = schedule.groupBy("row").agg(F.sum("words").alias("taken"))
    return Mix(known.select("row", "id", "source", "size", "source_size", "target"), taken, schedule)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for each reading of a document, cut after the words taken in it.

    Only the one document at which a source's quota ends is cut; its words are then joined by one
    space. Documents that the mix doesn't take are left out. Columns and types stay; n_chars
    follows the text.
    """
    numbered = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    mix = mix_sources(numbered, row="_row")
    reads = mix.schedule.groupBy("row", "cycle").agg(F.sum("words").alias("_words")).join(mix.rows.select("row", "size"), "row")
    whole = numbered.join(reads, numbered._row == reads.row)
    head = F.expr(rf"array_join(slice(filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> ''), 1, cast(_words as int)), ' ')")
    whole = whole.withColumn("text", F.when(F.col("_words") < F.col("size"), head).otherwise(F.col("text")))
    return whole.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"))
    out = mix.rows.join(mix.taken, "row", "left")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
