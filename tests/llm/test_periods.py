import hashlib
import random
import re
import zlib

import numpy as np

from patchloom.llm.common import mix
from patchloom.llm.periods import op13_periodic_runs, periodic_runs, word_runs

SCHEMA = "doc_id long, text string, runs string, collapsed int"


def slow_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(12, 2 * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def hashed(docs):
    flat = np.array([x + 1 for d in docs for x in d], np.uint64)
    return word_runs(mix(flat), np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)).tolist()


def some(rng, kind):
    """Word sequences rich in runs: binary noise, Fibonacci and Thue-Morse words, planted, nested and meeting runs."""
    if kind == 0:
        return rng.choices(range(2), k=rng.randrange(400))
    if kind == 1:
        a, b, n = [0], [0, 1], rng.randrange(20, 900)
        while len(b) < n:
            a, b = b, b + a
        return b
    if kind == 2:
        root = rng.choices(range(3), k=rng.randrange(1, 200))
        return rng.choices(range(9), k=20) + (root * 6)[: len(root) * 2 + rng.randrange(len(root) * 3 + 1)] + rng.choices(range(9), k=20)
    if kind == 3:
        root = rng.choices(range(2), k=rng.randrange(1, 9))
        return (root * 100)[: rng.randrange(20, 400)] + (root * 100)[rng.randrange(len(root)) :][: rng.randrange(20, 400)]
    if kind == 4:
        root = rng.choices(range(2), k=rng.randrange(1, 6))
        block = (root * 30)[: rng.randrange(10, 100)] + [7] * rng.randrange(3)
        return (block * 6)[: rng.randrange(len(block) * 2, len(block) * 6)]
    if kind == 5:
        return [bin(i).count("1") % 2 for i in range(rng.randrange(600))]
    return []


def test_every_run_of_rich_sequences():
    rng = random.Random(11)
    for trial in range(60):
        docs = [some(rng, (trial + k) % 7) for k in range(4)]
        assert hashed(docs) == [[k, *r] for k, d in enumerate(docs) for r in slow_runs(d)]


def test_runs_across_the_meeting_of_two_equal_periods():
    """Left and right of the break any odd stretch is a square: many runs of long periods without a minimizer."""
    w = [0, 1] * 120 + [0, 0] + [1, 0] * 120
    got = hashed([w])
    assert got == [[0, *r] for r in slow_runs(w)] and sum(r[3] >= 64 for r in got) > 30


def test_seeds_stay_few_in_repeated_text():
    """One million equal words, and a period of one below the first scale, take no quadratic work."""
    assert hashed([[5] * 1_000_000]) == [[0, 0, 1_000_000, 1]]
    assert hashed([list(range(31)) * 20_000 + [77]]) == [[0, 0, 620_000, 31]]
    assert hashed([list(range(40)) * 10_000]) == [[0, 0, 400_000, 40]]


def slow(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n_},{q}\n" for s, n_, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_odd_rows(spark, tmp_path):
    texts = [None, "", " \n", "one", "a " * 11, "a " * 12, "    " * 9, "a b\tc\n" * 4, "é🎉 " * 40 + "x", "x " + "y z " * 30 + "w", "a\x1fb c " * 8, " ".join(map(str, range(70))) * 3, " ".join(map(str, [*range(50), *range(50), 7]))]
    rows = [(i, texts[i % len(texts)]) for i in range(150)] + [(None, "a b " * 9), (None, None), (3, "k " * 20), (3, "k " * 20)]
    spark.createDataFrame([(i, t, "r", 1) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (str(r[0]), r[6], r[7])
    got = sorted(map(tuple, op13_periodic_runs(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted((slow(*r) for r in rows), key=key)
    empty = periodic_runs(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_words", "runs", "collapsed"]


def test_collapsed_text(spark):
    df = spark.createDataFrame([(1, "  x \n y  " + "go on " * 8 + "end", "r", 1)], SCHEMA)
    r = periodic_runs(df).collect()[0]
    assert r.n_words == 19 and [tuple(x) for x in r.runs] == [(2, 16, 2)] and r.collapsed == "x y go on end"


def test_query(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").collect()
    few = {r.doc_id for r in docs if len((r.text or "").split()) <= 1500}  # the slow version is quadratic
    got = {r.doc_id: tuple(r) for r in op13_periodic_runs(spark, data_dir).collect()}
    assert len(got) == len(docs) and len(few) > 150
    for r in docs:
        if r.doc_id in few:
            assert got[r.doc_id] == slow(r.doc_id, r.text)
