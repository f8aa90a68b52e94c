"""Harmonic packing of tokenized documents into sequences of one capacity.

A length in (C/(k+1), C/k] is of class k, and k pieces of class k fill a bin. Every worker cuts its
documents into pieces that nearly exhaust their class and numbers them by class; a prefix sum over
the workers' counts gives each piece its place, so bins fill without any worker seeing another's
pieces. Only the last, unfilled bin of each class (fewer than k pieces each, a number that the
capacity bounds) is packed again, first-fit by decreasing length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows, stored, table

CAPACITY, END_ID = 2048, 1
#: A piece stays in class k if k like it leave at most this part of the capacity free.
SLACK = 64
#: The vocabulary of byte_bpe_50k.json as ranks: the same ids, encoded in a third of the time.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Fixed value: the added token of byte_bpe_50k.json, which its library takes for one id wherever a text holds it.
ADDED = {"<|endoftext|>": 50256}
#: public_tokenizers.PATTERN with possessive quantifiers: the same pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=ADDED)


def cuts(n: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[tuple[int, int]]:
    """(length, class) of the pieces of n tokens, in order."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= capacity // slack or capacity // (k + 1) == 0:
            out.append((rest, k))
            break
        out.append((capacity // (k + 1), capacity // (capacity // (k + 1))))
        rest -= capacity // (k + 1)
    return out


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ranks: str = RANKS) -> DataFrame:
    """Tokenizes and cuts every document: (id, start, length, doc_tokens, ids, class, worker, place).

    ids holds the piece's ids as little-endian unsigned 32-bit numbers. A null or empty text is the
    end id alone. Repeated rows and null ids are documents like others; other columns aren't read.
    """
    schema = pa.schema([(id_col, pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("class", pa.int32()), ("worker", pa.int32()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, worker = encoder(ranks).encode_to_numpy, TaskContext.get().partitionId()
        allowed = frozenset(ADDED)
        places: dict[int, int] = {}
        for batch in batches:
            for lo in range(0, len(batch), 256):
                out: list[list] = [[] for _ in schema]
                for i, text in zip(batch.column(0)[lo : lo + 256].to_pylist(), batch.column(1)[lo : lo + 256].to_pylist(), strict=True):
                    ids = np.append(encode(text or "", allowed_special=allowed), end_id).astype("<u4")
                    start = 0
                    for length, k in cuts(len(ids), capacity):
                        place = places.get(k, 0)
                        for column, value in zip(out, (i, start, length, len(ids), ids[start : start + length].tobytes(), k, worker, place), strict=True):
                            column.append(value)
                        places[k] = place + 1
                        start += length
                yield rows(schema, *out)

    source = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"{id_col} long, start long, length long, doc_tokens long, ids binary, class int, worker int, place long")


def fill_bins(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a stored table of cut_documents' pieces; ids may be left out.

    k pieces of class k share a sequence. The order of pieces in it is their number's. A sequence is
    padded to the capacity unless its tokens are a power of two. No pieces: no rows.
    """
    counts = pieces.groupBy("worker", "class").agg(F.count("*").alias("held"))
    before = Window.partitionBy("class").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    totals = {r["class"]: r.total for r in counts.groupBy("class").agg(F.sum("held").alias("total")).collect()}  # a row for each class: fewer than the capacity
    base, bases = 0, []
    for k in sorted(totals):
        bases.append((k, base, totals[k] // k))
        base += totals[k] // k
    spark = pieces.sparkSession
    plan = spark.createDataFrame(bases, "class int, base long, bins long")
    numbered = pieces.join(starts.drop("held"), ["worker", "class"]).join(plan, "class")
    numbered = numbered.withColumn("number", F.col("before") + F.col("place"))
    kept = [c for c in pieces.columns if c not in ("worker", "place")]
    full = numbered.where(F.col("number") < F.col("bins") * F.col("class"))
    full = full.withColumn("sequence_id", F.expr("base + number div class"))
    inside = Window.partitionBy("sequence_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).select(*kept, "sequence_id", "offset")

    def first_fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "class", "number"], ascending=[False, True, True], kind="stable")
        used: list[int] = []
        ids, offsets = [], []
        for n in pdf["length"]:
            j = next((j for j, u in enumerate(used) if u + n <= capacity), len(used))
            if j == len(used):
                used.append(0)
            ids.append(base + j)
            offsets.append(used[j])
            used[j] += n
        return pdf.assign(sequence_id=ids, offset=offsets)[[*kept, "sequence_id", "offset"]]

    rest = numbered.where(F.col("number") >= F.col("bins") * F.col("class")).select(*kept, "number")
    types = {f.name: f.dataType.simpleString() for f in pieces.schema}
    rest = rest.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(first_fit, ", ".join(f"{c} {types[c]}" for c in kept) + ", sequence_id long, offset long")
    return full.unionByName(rest)


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """cut_documents and fill_bins, with the ids of every piece."""
    return fill_bins(stored(cut_documents(docs, **options), "pieces"), options.get("capacity", CAPACITY))


def packed_digest(docs: DataFrame) -> DataFrame:
    pieces = cut_documents(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return fill_bins(stored(pieces, "pieces")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("class").alias("harmonic_class"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents"))
