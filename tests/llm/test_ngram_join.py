import random
import re

import numpy as np
import pytest

from patchloom.llm import ngram_join
from patchloom.llm.ngram_join import ngram_jaccard_join, op3_ngram_join, tile_overlaps

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n int, cid string, token string"


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    """Every pair, then label passing."""
    sets = [(i, shingles(t)) for i, t in docs]
    comp = list(range(len(sets)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    links = [0] * len(sets)
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                comp[root(a)] = root(b)
                links[a] += 1
                links[b] += 1
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(s), least[root(k)], links[k]) for k, (i, s) in enumerate(sets))


def texts(seed, groups, size):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    out = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(3, 120))
        for _ in range(rng.randint(1, size)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(rng.choice([" ", "\t", "\n "]).join(words) + (f" {passage}" if rng.random() < 0.3 else ""))
    return out


def test_against_every_pair(spark):
    docs = list(enumerate(texts(1, 30, 14)))
    rows = spark.createDataFrame([(i, t, 1, "x", None) for i, t in docs], SCHEMA).repartition(5)
    got = ngram_jaccard_join(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got.documents.collect()) == brute(docs)


def near_group(seed, size, changes):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = rng.choices(vocabulary, k=140)
    docs = []
    for i in range(size):
        words = list(base)
        for _ in range(rng.randint(*changes)):
            words[rng.randrange(140)] = rng.choice(vocabulary)
        docs.append((5000 - i, " ".join(words)))
    return docs


@pytest.mark.parametrize("tile", [ngram_join.TILE_CLASSES, 40])
def test_near_group(spark, monkeypatch, tile):
    """In one tile, and cut into several that visit each other."""
    monkeypatch.setattr(ngram_join, "TILE_CLASSES", tile)
    docs = near_group(5, 150, (0, 6))
    rows = spark.createDataFrame([(i, t, 1, "x", None) for i, t in docs], SCHEMA)
    got = ngram_jaccard_join(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got.documents.collect()) == brute(docs)
    for r in got.links.collect():
        assert 100 * r.overlap >= 75 * (r.n_a + r.n_b - r.overlap)


def test_rows_grow_with_a_group_not_with_its_pairs(spark, monkeypatch):
    held = {}

    def counting(df, name="part", real=ngram_join.stored):
        out = real(df, name)
        held[name] = max(held.get(name, 0), out.count())
        return out

    monkeypatch.setattr(ngram_join, "stored", counting)
    seen = []
    monkeypatch.setattr(ngram_join, "TILE_CLASSES", 50)  # 2, 16 and 32 portions
    for size in (100, 800, 1600):
        held.clear()
        docs = near_group(7, size, (3, 8))
        ngram_jaccard_join(spark.createDataFrame([(i, t, 1, "x", None) for i, t in docs], SCHEMA))
        seen.append((held["meetings"] + held["seats"] + held["counted"]) / size)
    assert max(seen) < 20 and seen[1] < 2.2 * seen[0] and seen[2] < 2 * seen[1]


def test_near_group_across_true_tiles(spark):
    """2,300 near copies: three portions of the true size in two tiles, every link counted."""
    docs = near_group(9, 2300, (0, 4))
    got = ngram_jaccard_join(spark.createDataFrame([(i, t, 1, "x", None) for i, t in docs], SCHEMA)).documents.collect()
    words = [t.split() for _, t in docs]
    grams = {}
    sets = [np.unique([grams.setdefault(tuple(w[k : k + 5]), len(grams)) for k in range(len(w) - 4)]) for w in words]
    has = np.zeros((len(docs), len(grams)), np.float32)
    for k, x in enumerate(sets):
        has[k, x] = 1
    overlap, size = has @ has.T, has.sum(1)
    linked = 175 * overlap >= 75 * (size[:, None] + size[None, :])
    ids, comp = np.array([i for i, _ in docs]), None
    new = ids
    while comp is None or (new != comp).any():
        comp, new = new, np.where(linked, new[None, :], 1 << 40).min(1)
    want = zip(ids.tolist(), map(len, sets), comp.tolist(), (linked.sum(1) - 1).tolist(), strict=True)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == sorted(want)


def test_counts_in_fragments():
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(400, rng.integers(1, 300), replace=False)) for _ in range(60)] + [np.arange(k, 300) for k in range(50)]
    sizes = np.array([len(s) for s in sets])
    ends = np.array([[np.searchsorted(s, 100 * (f + 1)) for f in range(4)] for s in sets])
    allowed = ~np.eye(len(sets), dtype=bool)
    got = tile_overlaps(np.concatenate(sets), ends, sizes, allowed, 75, 100)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            o = len(np.intersect1d(x, y))
            assert got[i, j] == (o if i != j and 175 * o >= 75 * (len(x) + len(y)) else 0)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, "two one"), (7, "one  two"), (7, "one two"), (None, "a b c d e f"), (9, "a b c d e f"), (10, "x " * 5000), (11, "x x x x x")]
    rows = spark.createDataFrame([(i, t, 1, "x", None) for i, t in docs], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard_join(rows).documents.collect()), key=str)
    want = [(1, 0, 1, 0), (2, 0, 2, 0), (3, 0, 3, 0), (4, 1, 4, 3), (5, 1, 4, 3), (6, 1, 6, 0), (7, 1, 4, 3), (7, 1, 4, 3), (None, 2, 9, 1), (9, 2, 9, 1), (10, 1, 10, 1), (11, 1, 10, 1)]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert ngram_jaccard_join(spark.createDataFrame([], SCHEMA)).documents.collect() == []


def test_query(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in op3_ngram_join(spark, data_dir).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs])
