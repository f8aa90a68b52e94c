"""Periodic runs of words by multi-scale minimizers.

A run is a maximal stretch of words with a smallest period q that is at least two periods long. Short
periods are found by comparing the words with themselves at every lag. Longer ones go by scales: for
periods in [W, 2W), every window of W words keeps its least hash of W/2 words (its minimizer). Inside
a run a window and the one a period further are equal, so their minimizers stand a period apart:
pairs of equal minimizers at such distances are the seeds, and each is extended to both sides at its
lag by binary search over prefix hashes.

Grams with a period of a quarter of W or less never are minimizers, so equal ones stand more than W/4
apart and a minimizer has fewer than eight partners: no list of pairs grows with the square of a
repeated word. What that leaves out are runs whose root, but for its end, has such a short period d.
They lie across the place where two runs of period d meet, and are looked for there. All runs are
found this way, whatever the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, mix, table, text_chunks
from .ngram_join import word_bounds

#: The least length of a run, in words, and the first scale: shorter periods are found by lag scans. Grams of half a scale must be as long as a run.
LEAST, SCALE = 12, 32
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Prefix:
    """Hashes of any stretches of an array of hashed words, from one running sum."""

    def __init__(self, words: np.ndarray, rolling: Rolling) -> None:
        n = len(words)
        rolling._grow(n + 1)
        self.up, self.total = rolling.up, np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(words * rolling.down[:n], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.total[end] - self.total[start]) * self.up[start]


def _longest(same, limit: np.ndarray) -> np.ndarray:
    """The greatest t <= limit with same(t), which holds up to some t and not beyond, by binary search for all at once."""
    t = np.zeros(len(limit), np.int64)
    step = 1 << max(0, int(limit.max(initial=0)).bit_length() - 1)
    while step:
        may = np.flatnonzero(t + step <= limit)
        may = may[same(may, t[may] + step)]
        t[may] += step
        step >>= 1
    return t


def extended(prefix: Prefix, at: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """(start, end, lag) of the stretches around words `at` in which words `lag` apart are equal, those of two periods or more, each once."""
    n, far = len(prefix.total) - 1, at + lag
    ahead = _longest(lambda k, t: prefix.of(at[k], at[k] + t) == prefix.of(far[k], far[k] + t), n - far)
    back = _longest(lambda k, t: prefix.of(at[k] - t, at[k]) == prefix.of(far[k] - t, far[k]), at)
    found = np.stack([at - back, far + ahead, lag], 1)
    return np.unique(found[found[:, 1] - found[:, 0] >= 2 * lag], axis=0)


def lag_runs(words: np.ndarray, lag: int) -> np.ndarray:
    """(start, end, lag) of the maximal stretches with that period, by one comparison of the words with themselves."""
    if len(words) <= lag:
        return np.zeros((0, 3), np.int64)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], words[lag:] == words[:-lag], [False]))))
    start, end = edges[::2], edges[1::2]
    good = end - start >= max(lag, LEAST - lag)
    return np.stack([start[good], end[good] + lag, np.full(good.sum(), lag)], 1)


def smallest(runs: np.ndarray) -> np.ndarray:
    """Of stretches with the same start and end the one of the smallest period: the others' periods are multiples of it."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.concatenate(([True], np.any(np.diff(runs[:, :2], axis=0) != 0, axis=1)))] if len(runs) else runs


def minimizers(grams: np.ndarray, window: int) -> np.ndarray:
    """The places whose value is the least in some window of so many places; _NONE never is."""
    if len(grams) < window:
        return np.zeros(0, np.int64)

    def over(x: np.ndarray, best) -> np.ndarray:
        span = 1
        while 2 * span <= window:
            x, span = best(x[:-span], x[span:]), 2 * span
        return best(x[: len(x) - window + span], x[window - span :]) if span < window else x

    least = over(grams, np.minimum)
    edge = np.zeros(window - 1, np.uint64)
    return np.flatnonzero((over(np.concatenate((edge, least, edge)), np.maximum) == grams) & (grams != _NONE))


def seeds(prefix: Prefix, runs: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, distance) of equal minimizers from one scale to less than two apart; runs are those found at smaller periods."""
    gram = scale // 2
    count = len(prefix.total) - gram
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.arange(count)
    values = mix(prefix.of(start, start + gram))
    dull = runs[(runs[:, 2] <= gram // 2) & (runs[:, 1] - runs[:, 0] >= gram)]
    if len(dull):
        cover = np.zeros(count + 1, np.int64)
        np.add.at(cover, dull[:, 0], 1)
        np.add.at(cover, dull[:, 1] - gram + 1, -1)
        values = np.where(np.cumsum(cover[:-1]) > 0, _NONE, values)
    at = minimizers(values, scale - gram + 1)
    at = at[np.argsort(values[at], kind="stable")]  # equal ones together, in order of place
    found, step = [], 1
    while step < len(at):
        near = np.flatnonzero((values[at[step:]] == values[at[:-step]]) & (at[step:] - at[:-step] < 2 * scale))
        if not len(near):
            break
        found.append(np.stack([at[near], at[near + step] - at[near]], 1))
        step += 1
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    pairs = pairs[pairs[:, 1] >= scale]
    return pairs[:, 0], pairs[:, 1]


def meeting(prefix: Prefix, runs: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, lag) to try where two runs of one period meet, for lags of the scale that are longer than four of that period."""
    long = runs[(4 * runs[:, 2] <= scale) & (runs[:, 1] - runs[:, 0] >= scale)]
    long = long[np.lexsort((long[:, 0], long[:, 2]))]
    touch = np.flatnonzero((long[1:, 2] == long[:-1, 2]) & (long[1:, 0] <= long[:-1, 1])) if len(long) > 1 else []
    at, lags = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for (a, b, d), (c, e, _) in zip(long[touch].tolist(), long[np.asarray(touch, int) + 1].tolist(), strict=True):
        turn = c - (b - d) + np.arange(d)  # the last period of the one run, found again in the other
        turn = turn[prefix.of(np.full(d, b - d), np.full(d, b)) == prefix.of(b - d + turn, b + turn)]
        if len(turn):
            lag = np.arange(turn[0] + -(-(scale - turn[0]) // d) * d, min(2 * scale, b - a + 1, e - c + 1), d)
            at.append(np.maximum(a, c - lag))
            lags.append(lag)
    return np.concatenate(at), np.concatenate(lags)


def word_runs(words: np.ndarray, offsets: np.ndarray, rolling: Rolling | None = None) -> np.ndarray:
    """(document, start, length, period) of every run, in that order of columns' weight; words are hashes, offsets their documents' bounds.

    A word that no document has stands after each one, so no stretch of two periods passes an end.
    """
    rolling, sizes = rolling or Rolling(), np.diff(offsets)
    found = np.zeros((0, 4), np.int64)  # document, start, end, period; words counted over all documents
    docs, scale = np.flatnonzero(sizes >= LEAST), 1
    while len(docs):
        size = sizes[docs]
        start = np.cumsum(size + 1) - size - 1  # the documents of two periods or more, each with its own last word
        own = np.repeat(np.arange(len(docs)), size)
        inside = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        text = mix(~np.arange(len(own) + len(docs), dtype=np.uint64))
        text[start[own] + inside] = words[offsets[docs][own] + inside]
        shift = start - offsets[docs]
        known = np.isin(found[:, 0], docs)
        moved = shift[np.searchsorted(docs, found[known, 0])]
        runs = found[known, 1:] + np.stack([moved, moved, 0 * moved], 1)
        if scale == 1:
            runs = smallest(np.concatenate([lag_runs(text, q) for q in range(1, SCALE)]))
            scale = SCALE
        else:
            prefix = Prefix(text, rolling)
            at, lag = (np.concatenate(x) for x in zip(seeds(prefix, runs, scale), meeting(prefix, runs, scale), strict=True))
            runs = smallest(np.concatenate([runs, extended(prefix, at, lag)]))
            scale *= 2
        which = np.searchsorted(start, runs[:, 0], "right") - 1
        found = np.concatenate([found[~known], np.stack([docs[which], runs[:, 0] - shift[which], runs[:, 1] - shift[which], runs[:, 2]], 1)])
        docs = docs[sizes[docs] >= 2 * scale]
    out = np.stack([found[:, 0], found[:, 1] - offsets[found[:, 0]], found[:, 2] - found[:, 1], found[:, 3]], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, runs: np.ndarray) -> pa.Array:
    """For each text its words that no run holds after its first period, joined by one space."""
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, first[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
    np.add.at(cover, first[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
    keep = np.cumsum(cover[:-1]) == 0
    left = np.concatenate(([0], np.cumsum(keep)))[first]  # words kept before each text
    size = (ends - starts)[keep]
    room = np.concatenate(([0], np.cumsum(size + 1)))  # each word with a space after it
    before, k = np.repeat(np.cumsum(size) - size, size), np.arange(size.sum())
    out = np.full(int(room[-1]), 0x20, np.uint8)
    out[np.repeat(room[:-1], size) + k - before] = data[np.repeat(starts[keep], size) + k - before]
    some = np.diff(left) > 0
    out = np.delete(out, room[left[1:][some]] - 1)  # no space after a text's last word
    bounds = room[left] - np.concatenate(([0], np.cumsum(some)))
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) for every row: each run's start, length and period in words, in order of start and period.

    Words are stretches without ASCII white space. collapsed has every word that no run holds after its
    first period. Null, empty and blank texts have no words, no runs and collapse to the empty text.
    Rows are worked on alone, whole and whatever their length; repeated rows give repeated results.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    types = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for b in batches:
            for lo, hi, data, offsets in text_chunks(b, 1):
                starts, ends = word_bounds(data, offsets) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                first = np.searchsorted(starts, offsets)
                runs = word_runs(rolling.slices(data, starts, ends), first, rolling)
                rows = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(types.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(runs[:, 0], np.arange(hi - lo + 1)).astype(np.int32)), rows).cast(types)
                text = collapsed(data, starts, ends, first, runs)
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(np.diff(first).astype(np.int64)), lists, text], names=[id_col, "n_words", "runs", "collapsed"])

    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): every tenth text by the id's crc32 ends in copies of some of its words: the trial that the query sets. A null id plants nothing."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    planted = """transform(array(regexp_extract_all(_text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)), w -> transform(array(struct(size(w) AS n, (_g % size(w)) AS a)), v ->
        array_join(transform(sequence(0L, v.n - 1L), i -> w[int(if(i < v.a, i, v.a + (i - v.a) % (1 + (v.n - v.a) div (3 + _g % 8))))]), ' '))[0])[0]"""
    own = docs.select(id_col, F.col(text_col).alias("_text"), h.alias("_h")).withColumn("_g", F.expr("_h div 10"))
    has = F.col("_text").rlike(r"[^\x20\x09-\x0D]") & (F.col("_h") % 10 == 0)
    return own.select(id_col, F.when(has, F.expr(planted)).otherwise(F.col("_text")).alias(text_col))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS back, -r.period AS lag)))")
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\\n'), '')")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.back")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.lag")).alias("period"),
        F.expr("(1000 * _best.length) div (-_best.lag)").alias("exponent_milli"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
