import zlib
from collections import Counter

import numpy as np

from patchloom.llm.language import MIN_RATIO, LanguageFilter, bit_sliced, grams, identify_languages, learn, op10_language, slots_for

SCHEMA = "doc_id long, text string, lang string, score string, lang_pred int"


def test_held_out_accuracy(spark, data_dir):
    truth = {r.doc_id: (r.text, r.lang) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    got = op10_language(spark, data_dir).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    long = [r for r in got if r.held_out and len(truth[r.doc_id][0]) > 100]
    assert np.mean([r.lang_pred == truth[r.doc_id][1] for r in long]) > 0.95


def test_query_against_exact_sets(spark, data_dir):
    """Languages by exact sets of n-grams; a filter may only differ where two languages are near each other."""
    docs = [(r.doc_id, r.text or "", r.lang) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    train = [(t, lang) for i, t, lang in docs if zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None]
    counts: dict = {}
    for t, lang in train:
        counts.setdefault(lang, Counter()).update(grams([t])[0].tolist())
    share = {lang: {g: n / c.total() for g, n in c.items()} for lang, c in counts.items()}
    highest = Counter()
    for own in share.values():
        for g, x in own.items():
            highest[g] = max(highest[g], x)
    sets = {lang: {g for g, x in own.items() if x >= MIN_RATIO * highest[g]} for lang, own in share.items()}
    got = {r.doc_id: r for r in op10_language(spark, data_dir).collect()}
    for i, t, _ in docs:
        g = grams([t])[0].tolist()
        if not g:
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        held = {lang: sum(x in own for x in g) / len(g) for lang, own in sets.items()}
        assert held[got[i].lang_pred] >= max(held.values()) - 0.02
        assert abs(got[i].score - held[got[i].lang_pred]) < 0.02


def test_ties_go_to_the_commoner_language(spark):
    df = spark.createDataFrame([(1, "abc abc abc", "xx", "s", 1), (2, "abc", "yy", "s", 1), (3, "abc", None, "s", 1)], SCHEMA)
    assert {r.lang_pred for r in identify_languages(df, learn(df)).collect()} == {"xx"}


def test_filter_holds_its_grams_and_rates_are_right(spark):
    rng = np.random.default_rng(1)
    members = [rng.integers(1, 1 << 60, 3000) for k in range(70)]
    df = spark.createDataFrame([(k, g) for k, own in enumerate(members) for g in own.tolist()], "number int, gram long").repartition(3)
    f = LanguageFilter.of([f"l{k}" for k in range(70)], bit_sliced(df, 70, slots_for(3000)))
    for k, g in enumerate(members):
        assert (f.containing(g)[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).all()
    false = f.containing(rng.integers(1, 1 << 60, 200_000))[:, 0] & np.uint64(1)
    assert abs(false.mean() - f.rates[0]) < 2e-3


def test_grams():
    g, owner = grams(["Ab", "", "é!"])
    assert owner.tolist() == [0, 0, 2]
    a, b, e = ord("a"), ord("b"), ord("é")
    assert g.tolist() == [a << 21 | b, a << 42 | b << 21, e << 21]


def test_edges(spark):
    rows = [(k, t, lang, "s", 1) for k, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("der hund und die katze", "de"), ("the cat", None), (None, "en"), ("", "de"), ("12 34 !?", "en"), ("漢字", "de"), ("the " * 300_000, "en"), ("ﬁne", "en")])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(df, learn(df)).collect()}
    assert got[0][0] == got[2][0] == got[7][0] == "en" and got[1][0] == "de"
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    none = df.limit(0)
    assert identify_languages(none, learn(none)).collect() == []
    assert {r.lang_pred for r in identify_languages(df, learn(none)).collect()} == {"und"}
