"""Quality classifier by positive-unlabelled learning.

A small network scores documents by what their characters, words and lines look like. It is fitted
to trusted positives and unlabelled web text by the non-negative unbiased risk: the risk of the
unlabelled as negatives, less the positives' part of it at the estimated class prior, held at zero
or above. The labelled training rows then give the class prior and a calibration of the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, fold, rows, stored, table, text_chunks
from .ngram_join import word_bounds

#: At most so many distinct texts of each kind (trusted positives, labelled negatives, unlabelled) are fitted to.
SAMPLE = 12_000
THRESHOLD = 0.7
HIDDEN, STEPS, BATCH, RATE, DECAY = 24, 1500, 512, 3e-3, 1e-4

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".", b",", b"!", b"?", b":;", b"'\"", b"()[]{}", b"-_", b"/\\", b"|", b"#", b"$", b"%", b"&", b"*", b"+=<>~^`", b"@", b"\n", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100))]
_KIND = np.full(256, len(_CLASSES), np.uint8)
for _k, _c in enumerate(_CLASSES):
    _KIND[list(_c)] = _k
N_KINDS = len(_CLASSES) + 1
FEATURES = N_KINDS + 12


def features(data: np.ndarray, offsets: np.ndarray, rolling: Rolling) -> np.ndarray:
    """A row for each document that stands in data; documents without a word are rows of zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), np.float32)
    if not len(data):
        return out
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kind = _KIND[data]
    counts = np.bincount(owner * N_KINDS + kind, minlength=n * N_KINDS).reshape(n, N_KINDS).astype(np.float64)
    size = np.maximum(1, np.diff(offsets))[:, None]
    out[:, :N_KINDS] = np.sqrt(counts / size)
    starts, ends = word_bounds(data, offsets)
    if not len(starts):
        return out
    doc = owner[starts]
    words = np.bincount(doc, minlength=n)
    per = np.maximum(1, words)
    length = (ends - starts).astype(float)
    upper = np.concatenate(([0], np.cumsum(kind == 0)))
    lower = np.concatenate(([0], np.cumsum(kind == 1)))
    many = upper[ends] - upper[starts]
    shout = (many >= 2) & (lower[ends] == lower[starts])
    last, first = kind[ends - 1], kind[starts]
    odd = (last >= 12) & (last <= 19) | (last == 5)
    alone = (length == 1) & (first >= 3) & (first <= 19)
    hashes = rolling.slices(data, starts, ends)
    mean = lambda x: np.bincount(doc, x.astype(float), n) / per
    order = np.lexsort((hashes, doc))
    fresh = np.concatenate(([True], (np.diff(hashes[order]) != 0) | (np.diff(doc[order]) != 0)))
    again = np.concatenate(([False], (np.diff(hashes) == 0) & (np.diff(doc) == 0)))
    newline = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], newline[newline < len(data) - 1] + 1)))
    lines = np.maximum(1, np.bincount(owner[line_start], minlength=n))
    more = [np.sqrt(mean(shout)), np.sqrt(mean(odd)), np.sqrt(mean(alone)), mean(length) / 10, np.sqrt(mean(length > 20)), np.bincount(doc[order][fresh], minlength=n) / per, np.log1p(words) / 5, np.sqrt(mean(again)), np.log1p(words / lines) / 3, np.sqrt(mean(many == 1)), np.sqrt(mean((last == 3) | (last == 4))), np.minimum(1, 3 / per)]
    out[:, N_KINDS:] = np.stack(more, 1)
    out[words == 0] = 0
    return out


def with_features(docs: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, y, x): the features of each text as 32-bit floats."""
    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for b in batches:
            for lo, hi, data, offsets in text_chunks(b, 1):
                yield rows(schema, b.column(0)[lo:hi], b.column(2)[lo:hi], list(features(data, offsets, rolling)))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y")).mapInArrow(run, "id long, y int, x array<float>")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class QualityModel:
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.center) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.margin(x) + self.shift)


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7) -> QualityModel:
    """Minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss, by Adam.

    Where a batch's negative part is below zero, the step goes up that part instead, as in the
    published algorithm (Kiryo et al., 2017).
    """
    rng = np.random.default_rng(seed)
    center, scale = unlabelled.mean(0), unlabelled.std(0) + 0.02
    m = QualityModel(center, scale, rng.normal(0, 0.3, (positive.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), 0.0)
    p, u = ((x - center) / scale for x in (positive, unlabelled))
    values = [m.w1, m.b1, m.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    steps = max(1, max(len(p), len(u)) // BATCH)
    for _ in range(-(-STEPS // steps)):
        pi, ui = rng.permutation(len(p)), rng.permutation(len(u))
        for a, b in zip(np.array_split(pi, min(steps, len(p))), np.array_split(ui, min(steps, len(u))), strict=False):
            x = np.concatenate((p[a], u[b]))
            h = np.tanh(x @ values[0] + values[1])
            g = h @ values[2] + values[3][0]
            gp, gu = g[: len(a)], g[len(a) :]
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            grad_p, grad_u = -prior * _sigmoid(gp) / len(a), _sigmoid(gu) / len(b)
            if negative < 0:
                d = -np.concatenate((grad_p, grad_u))
            else:
                d = np.concatenate((grad_p - prior * _sigmoid(-gp) / len(a), grad_u))
            back = d[:, None] * values[2] * (1 - h**2)
            grads = [x.T @ back + DECAY * values[0], back.sum(0), h.T @ d + DECAY * values[2], d.sum(keepdims=True)]
            step += 1
            for v, gr, f, s in zip(values, grads, first, second, strict=True):
                f += 0.1 * (gr - f)
                s += 0.001 * (gr**2 - s)
                v -= RATE * (f / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = values[0], values[1], values[2], float(values[3][0])
    return m


def calibrate(m: QualityModel, x: np.ndarray, y: np.ndarray) -> None:
    """Fits slope and shift of the score to labels by Newton steps, with Platt's smoothed targets."""
    g = m.margin(x)
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        q = _sigmoid(a * g + b)
        w = q * (1 - q) + 1e-9
        gr = np.array([((q - t) * g).sum() + 1e-3 * (a - 1), (q - t).sum()])
        h = np.array([[(w * g * g).sum() + 1e-3, (w * g).sum()], [(w * g).sum(), w.sum()]])
        da, db = np.clip(np.linalg.solve(h + 1e-9 * np.eye(2), gr), -1, 1)
        a, b = max(1e-3, a - da), b - db
    m.slope, m.shift = float(a), float(b)


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, seed: int = 7) -> QualityModel | None:
    """Fits to up to `sample` trusted positives and unlabelled documents; None without positives or other texts.

    The distinct texts with the least hashes are taken, so reruns agree and a repeated id or row takes no
    more room than any other. Labels other than 0 and 1 and rows with a null id are left out; an id
    labelled twice counts by its least label, and so do equal texts. The class prior is the share of
    positives among the labelled texts given, smoothed by one of each kind.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(text_col, F.lit("")), F.lit(seed)).alias("h"))
    each = stored(own.select("id", "h").join(marks, "id", "left").groupBy("h").agg(F.min("y").cast("int").alias("y")), "labelled")  # texts stay where they are
    totals = {r.y: r["count"] for r in each.groupBy("y").count().collect()}
    if not totals.get(1) or sum(totals.values()) == totals[1]:
        return None
    prior = (totals[1] + 1) / (totals[1] + totals.get(0, 0) + 2)
    drawn = [each.where(F.col("y").eqNullSafe(F.lit(k))).orderBy("h").limit(sample) for k in (1, 0, None)]
    chosen = drawn[0].unionByName(drawn[1]).unionByName(drawn[2])  # 12 bytes a row
    one = own.select("h", "text").join(F.broadcast(chosen), "h").groupBy("h").agg(F.first("y").alias("y"), F.first("text").alias("text"))
    got = with_features(one, "h", "text", "y").orderBy("id").collect()  # at most 3 * sample rows of FEATURES numbers
    x = np.array([r.x for r in got], np.float64)
    y = np.array([-1 if r.y is None else r.y for r in got])
    unlabelled = x[y == -1] if (y == -1).any() else x  # where all are labelled, all are the unlabelled mixture
    m = fit_pu(x[y == 1], unlabelled, prior, seed)
    if (y == 0).any():
        calibrate(m, np.concatenate((x[y == 1], x[y == 0])), np.concatenate((np.ones((y == 1).sum()), np.zeros((y == 0).sum()))))
    return m


def score_quality(docs: DataFrame, model: QualityModel | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds the score, 0 to 1, of every row; null and empty texts are scored as texts without words. Without a model all scores are 0.5."""
    own = [f for f in docs.schema if f.name != score_col]
    at = [f.name for f in own].index(text_col)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for b in batches:
            for lo, hi, data, offsets in text_chunks(b, at):
                score = model.score(features(data, offsets, rolling)) if model else np.full(hi - lo, 0.5)
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, pa.array(score, pa.float64())], names=[*b.schema.names, score_col])

    return docs.select(*[f"`{f.name}`" for f in own]).mapInArrow(run, f"{types}, `{score_col}` double")


def train_fold(spark: SparkSession, sf_dir: str) -> QualityModel | None:
    """The production model: from the tables' rows outside fold 2 of 4."""
    docs, labels = (table(spark, sf_dir, t).where(fold("doc_id", 4) != 2) for t in ("documents", "labels"))
    return train_quality(docs, labels)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out"))
    scored = score_quality(docs, train_fold(spark, sf_dir))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
