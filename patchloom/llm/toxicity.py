"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two words is the weighted number of letter triples that both hold as subsequences,
gaps allowed at a price, so an insult with inserted, dropped or separated characters stays near the
plain one. Words meet a few landmark words; the kernel values, whitened, are the features of a
linear support vector machine (Nyström), which says what words are like those that bear the label.

Labels are of documents and are passed on to their sentences. Runs of letters that the sentences of
toxic documents have many times as often as others make a word typical; the machine learns to tell
typical words, and copies of them with a letter more, from those of clean sentences. A typical word
need not be missing from clean text: the words that the machine takes go to their nearest landmark,
and each landmark's words weigh as much as the logarithm of how much more often toxic text has them.
A sentence is the sum of its words' weights less a little for each word, which is what a toxic text
of that length would have, and a document is as toxic as its worst stretch of sentences.

Since kernels are sums over triples, the trained machine is one weight a triple: scoring takes one
table look-up for each triple of a word, and each task scores a distinct word once.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, rows, stored, table

#: At most so many labelled rows of either kind are fitted to, and so many distinct words of either kind (some 100 bytes each) are collected.
SAMPLE, WORDS = 1500, 100_000
LANDMARKS, GAP_PRICE, SPAN = 256, 0.75, 5
#: Variants of each typical word, with one letter inserted or doubled, in training; the words that stand for clean text, and the hardest of them a round.
VARIANTS, HARMLESS, HARDEST = 6, 12_000, 2000
#: Lengths of the runs of letters, how many times as often toxic text must have one, and the chance of one such run among all if labels meant nothing.
RUNS, TYPICAL, CHANCE = (4, 5, 6), 8.0, 0.05
#: Margins that part the words of a landmark; words weigh no more than this; what is added to each part: so many words, and such a share of the landmark's.
STEPS, HEAVIEST, DOUBT, SHARED = (0.35, 0.8), 8.0, 0.5, 0.05
LONGEST = 24  # letters; longer words are read in overlapping windows
ROUNDS, PENALTY = 4, 1e-3
FLOOR = -1.0  # the margin of words that are certainly not toxic
CACHE = 1 << 19
SYMBOLS = 64
_OFFSETS = [(p, q, GAP_PRICE ** (q - 2)) for q in range(2, SPAN + 1) for p in range(1, q)]
SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)|\n")


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """A small number for each code point: a-z their own, other letters shared ones, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = 1 + c - 97 if 97 <= c <= 122 else 29 + c % 35
    return out


def units(text: str) -> list[str]:
    """The lower-cased words of a text, and after them runs of three or more single characters joined."""
    words = text.lower().split()
    out = list(words)
    single = [k for k, w in enumerate(words) if len(w) == 1]
    run = 0
    for n, k in enumerate(single):
        if n and k != single[n - 1] + 1:
            run = n
        if n - run >= 2 and (n + 1 == len(single) or single[n + 1] != k + 1):
            out.append("".join(words[single[run] : k + 1]))
    return out


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s and not s.isspace()]


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of each word between a start and an end mark, padded with 0, a row for each window; and the word's number."""
    flat = _symbols()[np.frombuffer("\0".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)] if words else np.zeros(0, np.uint8)
    lengths = np.array([len(w) for w in words], int)
    owner = np.repeat(np.arange(len(words)), lengths + 1)[: len(flat)]
    keep = flat > 0
    flat, owner = flat[keep], owner[keep]
    count = np.bincount(owner, minlength=len(words))
    start = np.cumsum(count) - count
    out = np.zeros((len(words), LONGEST + 2), np.uint8)
    at = np.arange(len(flat)) - start[owner] + 1
    short = at <= LONGEST
    out[owner[short], at[short]] = flat[short]
    out[:, 0] = 27
    out[np.arange(len(words)), np.minimum(count, LONGEST) + 1] = 28
    number = np.arange(len(words))
    more, whose = [], []
    for k in np.flatnonzero(count > LONGEST).tolist():  # the rest of long words, in windows that overlap by half
        word = np.concatenate(([27], flat[start[k] : start[k] + count[k]], [28]))
        for a in range(LONGEST // 2, len(word), LONGEST // 2):
            more.append(np.pad(word[a : a + LONGEST + 2], (0, max(0, LONGEST + 2 - len(word[a : a + LONGEST + 2])))))
            whose.append(k)
    if more:
        out[count > LONGEST, LONGEST + 1] = flat[start[count > LONGEST] + LONGEST]
        out, number = np.concatenate((out, np.array(more, np.uint8))), np.concatenate((number, np.array(whose)))
    return out, number


def triples(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each row's letter triples (0: none) and the weights of the columns."""
    c = codes.astype(np.int32)
    keys, weights = [], []
    for p, q, w in _OFFSETS:
        a, b, d = c[:, : -q or None], c[:, p : c.shape[1] - q + p], c[:, q:]
        keys.append(np.where((a > 0) & (b > 0) & (d > 0), (a * SYMBOLS + b) * SYMBOLS + d, 0))
        weights.append(np.full(a.shape[1], w))
    return np.concatenate(keys, 1), np.concatenate(weights)


def norms(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The square roots of the kernel of each row with itself; at least a small positive number."""
    order = np.argsort(keys, axis=1, kind="stable")
    k, w = np.take_along_axis(keys, order, 1), np.where(np.take_along_axis(keys, order, 1) > 0, weights[order], 0)
    new = np.concatenate((np.ones((len(k), 1), bool), k[:, 1:] != k[:, :-1]), 1)
    group = np.cumsum(new.ravel()) - 1
    total = np.bincount(group, w.ravel())
    return np.sqrt(np.maximum(1e-6, np.bincount(np.arange(len(k)).repeat(k.shape[1])[new.ravel()], total**2, len(k))))


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values, a row for each word (the best of its windows for a long one)."""
    lk, lw = triples(coded(landmarks)[0][: len(landmarks)])
    ln = norms(lk, lw)
    known = np.unique(lk[lk > 0])
    place = np.zeros(SYMBOLS**3, np.int32)
    place[known] = np.arange(1, len(known) + 1)
    dense = np.zeros((len(known) + 1, len(landmarks)))
    for j in range(len(landmarks)):
        np.add.at(dense[:, j], place[lk[j]], np.where(lk[j] > 0, lw, 0) / ln[j])
    dense[0] = 0
    out = np.zeros((len(words), len(landmarks)))
    for lo in range(0, len(words), 4096):
        part = words[lo : lo + 4096]
        codes, number = coded(part)
        keys, w = triples(codes)
        value = np.zeros((len(codes), len(landmarks)))
        for col in range(keys.shape[1]):
            value += w[col] * dense[place[keys[:, col]]]
        np.maximum.at(out, number + lo, value / norms(keys, w)[:, None])
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear machine with the squared hinge loss, by Newton steps on the rows inside the margin."""
    z = np.hstack([x, np.ones((len(x), 1))])
    v = np.zeros(z.shape[1])
    ridge = PENALTY * np.diag([1.0] * x.shape[1] + [1e-6])
    for turn in range(40):
        inside = y * (z @ v) < 1
        zi, wi = z[inside], weight[inside, None]
        new = np.linalg.solve(zi.T @ (wi * zi) + ridge, zi.T @ (weight[inside] * y[inside]))
        if np.allclose(new, v, atol=1e-7):
            break
        v = 0.5 * v + 0.5 * new if turn > 10 else new
    return v[:-1], float(v[-1])


def _runs(word: str) -> set[str]:
    """The runs of letters of a word between marks of its ends; a shorter word is one run."""
    s = "^" + "".join(c for c in word if c.isalpha())[:LONGEST] + "$"
    return {s[k : k + n] for n in RUNS for k in range(max(1, len(s) - n + 1))}


def variants(word: str, most: int, rng: np.random.Generator) -> list[str]:
    """Copies of a word with one letter more between its first and its last: any of a-z, or a letter twice."""
    letters = [c for c in word if c.isalpha()]
    if len(letters) < 4:
        return []
    out = []
    for k in range(most):
        at = int(rng.integers(1, len(letters)))
        more = letters[at] if k % 3 == 2 else chr(97 + int(rng.integers(26)))
        out.append("".join([*letters[:at], more, *letters[at:]]))
    return out


@dataclass
class ToxicityModel:
    table: np.ndarray  # a weight for each triple
    bias: float
    landmarks: list[str]  # of typical words
    weights: np.ndarray  # of the words of each landmark (row), by their margins (column)
    rate: float  # of words that weigh something, in toxic text
    slope: float = 1.0
    shift: float = 0.0

    def words(self, words: list[str]) -> np.ndarray:
        """The margin of each word, FLOOR if it can't be higher."""
        out = np.full(len(words), FLOOR)
        for lo in range(0, len(words), 4096):
            codes, number = coded(words[lo : lo + 4096])
            keys, w = triples(codes)
            top = (self.table[keys] * w).sum(1)
            least = np.sqrt(np.maximum(1e-6, ((keys > 0) * w**2).sum(1)))  # equal triples only add to the norm
            maybe = np.flatnonzero((top > 0) & (self.bias + top / least > FLOOR))
            if len(maybe):
                np.maximum.at(out, number[maybe] + lo, self.bias + top[maybe] / norms(keys[maybe], w))
        return out

    def weigh(self, words: list[str]) -> np.ndarray:
        """The weight of each word that the machine takes, by its nearest landmark and its margin, else 0."""
        out, margin = np.zeros(len(words)), self.words(words)
        hit = np.flatnonzero(margin > 0)
        if len(hit):
            out[hit] = self.weights[kernel([words[k] for k in hit], self.landmarks).argmax(1), np.digitize(margin[hit], STEPS)]
        return out

    def stretch(self, text: str, weight: dict[str, float]) -> tuple[float, str | None]:
        """The sum of the worst stretch of a text's sentences, 0 for none, and the worst of them."""
        best = run = 0.0
        worst, most = None, 0.0
        for s in sentences(text):
            words = units(s)
            held = sum(weight.get(w, 0.0) for w in words)
            own = held - self.rate * len(words)
            if held > 0 and (worst is None or own > most):
                worst, most = s, own
            run = max(0.0, run + own)
            best = max(best, run)
        return best, worst

    def score(self, sums: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * (self.slope * np.log1p(sums) + self.shift)))


def _typical(names: list[str], contexts: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """For each word how far its most telling run of letters is beyond chance (0: not typical), and that run.

    contexts has a row for each word: in how many contexts clean and toxic sentences have it.
    """
    seen: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(2))
    for w, c in zip(names, contexts, strict=True):
        for g in _runs(w):
            seen[g] += c
    total = np.maximum(1, contexts.sum(0))
    usual = total[1] / total.sum()
    bar = np.log(max(1, len(seen)) / CHANCE)
    grams = list(seen)
    n = np.array([seen[g] for g in grams]).reshape(-1, 2)
    share = n[:, 1] / np.maximum(1, n.sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        odd = np.where(share > 0, share * np.log(share / usual), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - usual)), 0)
    beyond = n.sum(1) * odd - bar  # above zero: too often in toxic sentences to be one of so many runs by chance
    often = n[:, 1] / total[1] >= TYPICAL * n[:, 0] / total[0]
    evidence = {g: e for g, e, o in zip(grams, beyond.tolist(), often.tolist(), strict=True) if o and e > 0}
    best, why = np.zeros(len(names)), [""] * len(names)
    for k, w in enumerate(names):
        for g in _runs(w):
            if evidence.get(g, 0.0) > best[k] or (g in evidence and evidence[g] == best[k] and g < why[k]):
                best[k], why[k] = evidence[g], g
    return best, why


def fit(words: list[tuple[str, int, int, int, int]], totals: tuple[int, int], seed: int = 11) -> ToxicityModel | None:
    """Fits to (word, tokens and contexts in clean, tokens and contexts in toxic sentences); totals are of all words there.

    None unless both kinds have words and some word is typical of the toxic ones.
    """
    words = sorted(w for w in words if any(c.isalpha() for c in w[0]))
    if not words or not min(totals):
        return None
    names = [w[0] for w in words]
    tokens, contexts = (np.array([[w[k], w[k + 2]] for w in words], float) for k in (1, 2))
    evidence, why = _typical(names, contexts)
    typical = np.flatnonzero((evidence > 0) & (tokens[:, 1] > 0))
    if not len(typical):
        return None
    rng = np.random.default_rng(seed)
    # landmarks: for each telling run, from the most telling on, the commonest word it made typical; far enough from the others
    by_run: dict[str, list[int]] = defaultdict(list)
    for k in typical[np.argsort(-tokens[typical, 1], kind="stable")].tolist():
        by_run[why[k]].append(k)
    landmarks: list[str] = []
    for turn in range(4):  # a word of each run, then another of each
        for g in sorted(by_run, key=lambda g: (-evidence[by_run[g][0]], g)):
            for k in by_run[g][turn : turn + 1]:
                if len(landmarks) < LANDMARKS // 3 and (not landmarks or kernel([names[k]], landmarks).max() < 0.65):
                    landmarks.append(names[k])
    plain = list(landmarks)
    for w in plain[: LANDMARKS // 8]:
        landmarks += variants(w, 2, rng)
    harmless = np.flatnonzero((tokens[:, 0] > 0) & (evidence == 0))
    near = np.zeros(len(harmless), np.float32)
    for lo in range(0, len(harmless), 4096):
        near[lo : lo + 4096] = kernel([names[k] for k in harmless[lo : lo + 4096]], plain).max(1)
    hard = harmless[np.argsort(-near, kind="stable")].tolist()
    for k in [*hard[: LANDMARKS // 5], *rng.permutation(harmless)[: LANDMARKS // 5].tolist()]:
        if names[k] not in landmarks:
            landmarks.append(names[k])
    gram = kernel(landmarks, landmarks)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-3))

    def mapped(words: list[str]) -> np.ndarray:
        return np.concatenate([(kernel(words[lo : lo + 4096], landmarks) @ whiten).astype(np.float32) for lo in range(0, max(1, len(words)), 4096)])

    known = set(names)
    order = typical[np.argsort(-tokens[typical, 1], kind="stable")]
    bent = [(v, tokens[k, 1]) for k in order[: HARMLESS // VARIANTS].tolist() for v in variants(names[k], VARIANTS, rng) if v not in known]
    held = [np.sqrt(tokens[typical, 1]), np.sqrt([h for _, h in bent])] if bent else [np.sqrt(tokens[typical, 1])]
    positive = np.concatenate([mapped([names[k] for k in typical]), *([mapped([v for v, _ in bent])] if bent else [])])
    mass = np.concatenate([0.5 * h / h.sum() / len(held) for h in held])
    negative = np.array(sorted({*hard[: HARMLESS // 2], *rng.permutation(harmless)[: HARMLESS // 2].tolist()}), int)
    x, tough = mapped([names[k] for k in negative]) if len(negative) else np.zeros((0, positive.shape[1]), np.float32), np.zeros(0, int)
    lk, lw = triples(coded(landmarks)[0][: len(landmarks)])
    spread = np.where(lk > 0, lw, 0) / norms(lk, lw)[:, None]
    for turn in range(ROUNDS):
        other = np.ones(len(negative)) / max(1, len(negative))
        if len(tough):  # half of it by the clean words that would be taken
            other = 0.5 * other + 0.5 * np.where(np.isin(negative, tough), tokens[negative, 0], 0) / tokens[tough, 0].sum()
        z = np.concatenate([positive, x]).astype(np.float64)
        u, bias = fit_svm(z, np.concatenate((np.ones(len(positive)), -np.ones(len(x)))), np.concatenate((mass, 0.5 * other)))
        triple = np.zeros(SYMBOLS**3)
        np.add.at(triple, lk, spread * (whiten @ u)[:, None])
        triple[0] = 0
        model = ToxicityModel(triple, bias, plain, np.zeros((len(plain), len(STEPS) + 1)), 0.0)
        if turn < ROUNDS - 1 and len(harmless):
            value = model.words([names[k] for k in harmless])
            tough = np.union1d(tough, harmless[np.argsort(-value, kind="stable")[:HARDEST]])
            more = np.setdiff1d(tough, negative)
            negative = np.concatenate((negative, more))
            x = np.concatenate((x, mapped([names[k] for k in more]))) if len(more) else x
    margin = model.words(names)
    hit = np.flatnonzero(margin > 0)
    if not len(hit):
        return None
    cell = kernel([names[k] for k in hit], plain).argmax(1) * (len(STEPS) + 1) + np.digitize(margin[hit], STEPS)
    taken = np.stack([np.bincount(cell, tokens[hit, k], model.weights.size) for k in (0, 1)], 1)
    rates = (taken / np.array(totals) * totals[1]).reshape(-1, len(STEPS) + 1, 2)  # tokens, as if there were as many of both kinds
    whole = rates.sum(1)
    even = (whole + DOUBT) / (whole + DOUBT).sum(1, keepdims=True)
    rates += (SHARED * whole + DOUBT * even)[:, None]
    odds = rates[..., 1] / rates[..., 0]
    model.weights = np.clip(np.log(odds), 0, HEAVIEST)
    model.rate = float(taken[odds.ravel() > 1].sum(0)[1] / totals[1])
    return model


def calibrate(model: ToxicityModel, sums: np.ndarray, y: np.ndarray, counts: np.ndarray) -> None:
    """Fits slope and shift of the score to documents' sums, each standing for counts of them, with Platt's smoothed targets."""
    g, counts = np.log1p(sums), counts * len(y) / counts.sum()
    n1, n0 = counts[y == 1].sum(), counts[y == 0].sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 2.0, -2.0
    for _ in range(60):
        q = 0.5 * (1 + np.tanh(0.5 * (a * g + b)))
        w, e = counts * q * (1 - q) + 1e-9, counts * (q - t)
        grad = np.array([(e * g).sum() + 1e-2 * (a - 2), e.sum()])
        h = np.array([[(w * g * g).sum() + 1e-2, (w * g).sum()], [(w * g).sum(), w.sum() + 1e-6]])
        da, db = np.clip(np.linalg.solve(h, grad), -1, 1)
        a, b = max(1e-2, a - da), b - db
    model.slope, model.shift = float(a), float(b)


def drawn_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """(y, text) of up to `sample` labelled texts of either label, and how many there are; equal texts are one, of the highest label.

    The texts with the least hashes are taken, so a repeated id or row takes no more room than any other.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    h = F.xxhash64(F.coalesce(text_col, F.lit("")), F.lit(seed))
    known = docs.select(F.col(id_col).cast("long").alias("id"), h.alias("h")).join(marks, "id")  # texts stay where they are
    each = stored(known.groupBy("h").agg(F.max("y").alias("y")), "labelled")
    totals = {r.y: r["count"] for r in each.groupBy("y").count().collect()}
    picked = [each.where(F.col("y") == k).orderBy("h").limit(sample) for k in (0, 1)]
    chosen = picked[0].unionByName(picked[1])  # 12 bytes a row
    texts = docs.select(F.coalesce(text_col, F.lit("")).alias("text"), h.alias("h")).join(F.broadcast(chosen), "h")
    return stored(texts.groupBy("h").agg(F.max("y").alias("y"), F.first("text").alias("text")).select("y", "text"), "drawn"), totals


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, words: int = WORDS, seed: int = 11) -> ToxicityModel | None:
    """Fits to the sentences of up to `sample` labelled texts and up to `words` of their distinct words of either label.

    Labels other than 0 and 1 and null ids are left out; an id labelled twice counts by its highest
    label, and so do equal texts. Null and empty texts have no sentences. None unless documents of both
    labels are there and some run of letters is typical of the toxic ones.
    """
    texts, totals = drawn_rows(docs, labels, id_col, text_col, label_col, sample, seed)
    if set(totals) != {0, 1}:
        return None
    schema = pa.schema([("y", pa.int32()), ("word", pa.string()), ("before", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = Counter((w, v) for u in map(units, sentences(text)) for v, w in zip(["", *u], u, strict=False))
                if found:
                    yield rows(schema, [y] * len(found), [w for w, _ in found], [v for _, v in found], found.values())

    # a word counts once after each other word, so copies of a passage add nothing to what is typical
    pairs = texts.select("y", "text").mapInArrow(run, "y int, word string, before string, n long").groupBy("word", "before").agg(*[F.sum(F.when(F.col("y") == k, F.col("n")).otherwise(0)).alias(f"t{k}") for k in (0, 1)])
    each = pairs.groupBy("word").agg(*[x for k in (0, 1) for x in (F.sum(f"t{k}").alias(f"t{k}"), F.sum((F.col(f"t{k}") > 0).cast("long")).alias(f"c{k}"))])
    each = stored(each, "words")
    size = each.agg(F.sum("t0"), F.sum("t1")).collect()[0]
    held = {tuple(r) for k in (0, 1) for r in each.where(F.col(f"t{k}") > 0).orderBy(F.xxhash64("word", F.lit(seed))).limit(words).collect()}
    model = fit(sorted(held), (size[0] or 0, size[1] or 0), seed)
    if model is not None:
        scored = summed(texts, model, "text", ["y"]).select("y", "sum").collect()  # at most two rows of numbers for each of the sample
        y = np.array([r.y for r in scored])
        calibrate(model, np.array([r["sum"] for r in scored]), y, np.where(y == 1, max(1.0, totals[1] / sample), max(1.0, totals[0] / sample)))
    return model


def summed(docs: DataFrame, model: ToxicityModel | None, text_col: str, keep: list[str]) -> DataFrame:
    """(*keep, sum, sentence): the sum of each text's worst stretch of sentences, and its worst sentence where one weighs anything."""
    own = [docs.schema[k] for k in keep]
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own) + "sum double, sentence string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        hot: dict[str, float] = {}
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                found: list[tuple[float, str | None]] = [(0.0, None)] * len(texts)
                if model is not None:
                    bags = [set(units(t)).union(*map(units, sentences(t))) for t in texts]
                    fresh = list(set().union(*bags) - seen)
                    if len(seen) > CACHE:
                        seen, hot = set(), {}
                        fresh = list(set().union(*bags))
                    seen.update(fresh)
                    hot.update((w, v) for w, v in zip(fresh, model.weigh(fresh).tolist(), strict=True) if v > 0)
                    found = [model.stretch(t, hot) if ws & hot.keys() else (0.0, None) for t, ws in zip(texts, bags, strict=True)]
                sums, worst = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sums, pa.float64()), pa.array(worst, pa.string())], names=[*keep, "sum", "sentence"])

    return docs.select(*[F.col(f"`{k}`") for k in keep], F.col(text_col).alias("_text")).mapInArrow(run, types)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_sentence: bool = False) -> DataFrame:
    """(id, *keep, score[, sentence]): 0 to 1 for every row; sentence is the worst one, of rows that score 0.5 or more.

    Null and empty texts and texts without letters get the score of harmless words. Without a model
    every score is 0. Every row is scored by its whole text, repeated rows alike.
    """
    found = summed(docs, model, text_col, list(dict.fromkeys([id_col, *keep])))
    score = F.lit(0.0) if model is None else 0.5 * (1 + F.tanh(0.5 * (model.slope * F.log1p("sum") + model.shift)))
    scored = found.withColumn("score", score)
    sentence = [F.when(F.col("score") >= 0.5, F.col("sentence")).alias("sentence")] * with_sentence
    return scored.select(id_col, *keep, "score", *sentence)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = train_toxicity(docs.where(fold("doc_id", 5) != 0), labels.where(fold("doc_id", 5) != 0))
    scored = score_toxicity(docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out")), model, keep=("held_out",))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
