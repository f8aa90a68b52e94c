"""Lempel-Ziv phrase fingerprints.

A document is parsed into phrases, each the shortest that the dictionary of its phrases does not
hold yet. The set of phrases is hashed, and the least hashes are the signature; two signatures give
an estimate of the share of phrases that the documents have in common, which is high where one
would compress well given the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, rows, table

SIGNATURE = 128
#: Ranges of ids that documents are dealt out in; beyond, a range takes more documents (it is streamed, not held).
MAX_RANGES = 1 << 16


def parse(text: str, at: int = 0, phrases: set[str] | None = None, cuts: list[int] | None = None, start: int = 0) -> tuple[set[str], list[int], int]:
    """Goes on parsing at `at`, in a phrase that began at `start`: phrases, their ends in order, start of the open one."""
    phrases = set() if phrases is None else phrases
    cuts = [] if cuts is None else cuts
    add, end = phrases.add, cuts.append
    for e in range(at + 1, len(text) + 1):
        if (w := text[start:e]) not in phrases:
            add(w)
            end(e)
            start = e
    return phrases, cuts, start


def signature(codes: np.ndarray, cuts: list[int], open_: int, rolling: Rolling, size: int = SIGNATURE) -> np.ndarray:
    """The `size` least 32-bit hashes of the phrases of a text (as code points); an open last phrase counts too."""
    ends = np.array(cuts + [len(codes)] * (open_ < len(codes)), np.int64)
    if not len(ends):
        return np.zeros(0, np.uint32)
    hashes = (rolling.slices(codes, np.concatenate(([0], ends[:-1])), ends) >> np.uint64(32)).astype(np.uint32)
    return np.unique(hashes)[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIGNATURE) -> float:
    """The share of the union's least hashes that both have; two empty texts are alike."""
    if not len(a) and not len(b):
        return 1.0
    least = np.union1d(a, b)[:size]
    return float(np.isin(least, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(least))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Fingerprinter:
    def __init__(self, size: int = SIGNATURE) -> None:
        self.size, self.rolling = size, Rolling()

    def pair(self, text: str, edited: str) -> tuple[np.ndarray, np.ndarray]:
        """The signatures of a text and an edit of it; their common beginning is parsed once."""
        same = len(text) - len(text) // 2
        phrases, cuts, start = parse(text[:same])
        _, cuts_b, start_b = parse(edited, same, set(phrases), list(cuts), start)
        _, cuts_a, start_a = parse(text, same, phrases, cuts, start)
        return signature(_codes(text), cuts_a, start_a, self.rolling, self.size), signature(_codes(edited), cuts_b, start_b, self.rolling, self.size)

    def one(self, text: str) -> np.ndarray:
        _, cuts, start = parse(text)
        return signature(_codes(text), cuts, start, self.rolling, self.size)


def hexed(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIGNATURE) -> DataFrame:
    """(id, fingerprint): the signature of each document as hexadecimal digits, 8 for each hash.

    Null is an empty text, whose fingerprint is empty. Equal texts have equal fingerprints.
    """
    schema = pa.schema([(id_col, pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(size)
        for b in batches:
            yield rows(schema, b.column(0), [hexed(maker.one(t or "")) for t in b.column(1).to_pylist()])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} long, fingerprint string")


def with_next(docs: DataFrame, id_col: str, text_col: str, per_range: int) -> DataFrame:
    """Deals the documents out in ranges of ids, each with a guest row: the first document of the next range.

    One shuffle of the texts; the order is by id, then text, nulls first. Only ids are looked at
    before, for the ranges' bounds and first ids. Returns (range, guest, id, text).
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    ranges = max(1, min(MAX_RANGES, -(-ids.count() // per_range)))
    bounds = sorted({int(x) for x in ids.where("id is not null").approxQuantile("id", [k / ranges for k in range(1, ranges)], 0.1 / ranges)}) if ranges > 1 else []
    held = spark.sparkContext.broadcast(np.array(bounds, np.int64))  # at most MAX_RANGES numbers
    least = -(1 << 63)  # stands for null

    @F.pandas_udf("int")
    def range_of(i: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held.value, i.to_numpy(np.int64), "right").astype(np.int32))

    known = ids.select(F.coalesce("id", F.lit(least)).alias("id")).withColumn("range", range_of("id"))
    first = sorted((r["range"], r["id"]) for r in known.groupBy("range").agg(F.min("id").alias("id")).collect())  # a row for each range
    heads = spark.sparkContext.broadcast({first[(k + 1) % len(first)][1]: first[k][0] for k in range(len(first))} if first else {})

    @F.pandas_udf("array<int>")
    def places(i: pd.Series) -> pd.Series:
        """Twice the id's range and, for the first id of a range, twice the range before, plus 1."""
        own = np.searchsorted(held.value, i.to_numpy(np.int64), "right")
        return pd.Series([[2 * r] if (g := heads.value.get(x)) is None else [2 * r, 2 * g + 1] for x, r in zip(i.tolist(), own.tolist(), strict=True)])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = source.withColumn("place", F.explode(places(F.coalesce("id", F.lit(least)))))
    return dealt.select(F.expr("place div 2").cast("int").alias("range"), F.expr("place % 2").alias("guest"), "id", "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIGNATURE, per_range: int = 512) -> DataFrame:
    """Each document beside an edit of it: its second half replaced by the beginning of the next document.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The order
    of documents is by id, then text; the last is followed by the first, a single one by itself.
    Null texts are empty; rows with equal ids, also null ones, are documents of their own.
    """
    schema = pa.schema([(id_col, pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(size)
        out: list[list] = [[] for _ in schema]
        last: tuple | None = None  # range, id, text
        waiting: tuple | None = None  # of the document before last: what only the signature of last completes
        done = -1  # the range whose guest came

        def finish(sig: np.ndarray) -> None:
            i, n, sha, own, edited = waiting
            for column, value in zip(out, (i, n, sha, hexed(own), hexed(edited), likeness(own, edited, size), likeness(own, sig, size)), strict=True):
                column.append(value)

        for b in batches:
            for r, guest, i, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r == done:
                    continue  # repeated guests
                if last is not None and last[0] == r:
                    half = len(last[2]) // 2
                    edited = last[2][: len(last[2]) - half] + text[:half]
                    own, own_edited = maker.pair(last[2], edited)
                    if waiting is not None:
                        finish(own)
                    waiting = (last[1], len(last[2]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, own_edited)
                last = (r, i, text)
                if guest:
                    finish(maker.one(text))
                    last, waiting, done = None, None, r
                if len(out[0]) >= 1000:
                    yield rows(schema, *out)
                    out = [[] for _ in schema]
        if out[0]:
            yield rows(schema, *out)

    dealt = with_next(docs, id_col, text_col, per_range)
    dealt = dealt.repartition("range").sortWithinPartitions("range", "guest", F.asc_nulls_first("id"), "text")
    return dealt.mapInArrow(run, f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
