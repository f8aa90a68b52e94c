"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from patchloom.sources.scratch import stored
from patchloom.sources.tables import table

__all__ = ["Rolling", "fold", "mix", "rows", "stored", "table", "text_chunks"]

#: Bytes of text that one numpy step takes; a longer document is a step of its own.
CHUNK_BYTES = 1 << 19


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts, F.lit(0))


def text_chunks(batch: pa.RecordBatch, column: int, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets from 0) of runs of rows with up to `most` bytes; null is empty."""
    text = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
    if not len(text):
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def rows(schema: pa.Schema, *columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2^64 of any slices of an array, from one running sum."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(m - 1, np.uint64(b), np.uint64))), dtype=np.uint64) for b in (self.BASE, self.INVERSE))

    def slices(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mixed hashes of values[start:end]; equal slices get equal hashes wherever they stand."""
        n = len(values)
        self._grow(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.down[:n], out=total[1:])
            return mix((total[ends] - total[starts]) * self.up[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
