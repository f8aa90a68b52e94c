import itertools
import random
import zlib

import numpy as np
import pytest

from patchloom.llm.toxicity import FLOOR, GAP_PRICE, LONGEST, SPAN, STEPS, drawn_rows, fit, kernel, op6_toxicity, score_toxicity, sentences, train_toxicity, units

SCHEMA = "doc_id long, text string, score string, predicted string, toxic long"


def slow_kernel(a, b):
    def phi(w):
        w, out = "^" + w + "$", {}
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i <= SPAN:
                out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + GAP_PRICE ** (k - i - 2)
        return out

    x, y = phi(a), phi(b)
    dot = lambda p, q: sum(v * q.get(t, 0) for t, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_kernel_is_the_gapped_subsequence_kernel():
    words = ["idiot", "idioot", "banana", "clown", "clwn", "a", "ab", "aaaaaaaa"]
    got = kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(slow_kernel(a, b))
    assert kernel(["i-d.i*o_t", "x" * 200 + "idiot" + "y" * 200], ["idiot"])[0, 0] == pytest.approx(1)


def test_units():
    assert units("You i d i o t now you") == ["you", "i", "d", "i", "o", "t", "now", "you", "idiot"] and "ab" not in units("x1 a b c1")


def make(rng, toxic):
    words = ["".join(rng.choices(["the", "on", "er", "ed", "st", "in", "th", "an"], k=rng.randint(1, 4))) for _ in range(60)]
    if toxic:
        for _ in range(2):
            words.insert(rng.randrange(60), rng.choice(["grumpox", "wuzzle", "blarf"]))
    return " ".join(words) + "."


def scores(spark, model, words, sentence="thon er {} ander st."):
    """The scores of one sentence with each word in it."""
    df = spark.createDataFrame([(k, sentence.format(w), None, None, None) for k, w in enumerate(words)], SCHEMA)
    return np.array([r.score for r in score_toxicity(df, model).orderBy("doc_id").collect()])


def test_learns_inserted_and_separated_characters(spark):
    rng = random.Random(1)
    docs = [(i, make(rng, i % 4 == 0), "s", "p", i % 4 == 0) for i in range(400)]
    df = spark.createDataFrame([(i, t, s, p, int(y)) for i, t, s, p, y in docs], SCHEMA)
    model = train_toxicity(df, df.select("doc_id", "toxic"))
    tests = {"grumpox": 1, "g-r-u-m-p-o-x": 1, "grrumpox!": 1, "G R U M P O X": 1, "theoned": 0, "wuzzle,": 1, "standing": 0}
    assert (scores(spark, model, tests) >= 0.5).astype(int).tolist() == list(tests.values())
    probe = spark.createDataFrame([(0, "one thing. thon er grumpox. st", None, None, None), (1, "standing. er", None, None, None)], SCHEMA)
    got = {r.doc_id: r.sentence for r in score_toxicity(probe, model, with_sentence=True).collect()}
    assert got[0].strip() == "thon er grumpox" and got[1] is None
    insults = ["grumpox", "wuzzle", "blarf"]
    assert (scores(spark, model, [w[:k] + w[k] + w[k:] for w in insults for k in range(len(w))]) >= 0.5).all()
    assert (scores(spark, model, [w[:k] + c + w[k:] for w in insults for k in range(1, len(w)) for c in "aeqsxz"]) >= 0.5).mean() > 0.9
    assert (scores(spark, model, ["stedthe", "inander", "onthed", "ererst", "anthinon"]) < 0.5).all()


def test_words_that_clean_text_has_too_count_by_how_many_there_are(spark):
    """Words of one beginning stand in 1 of 300 clean words and 1 of 25 toxic ones: no word is toxic, many are."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices(["la", "ne", "or", "ti", "su", "em", "da", "ro"], k=rng.randint(1, 4)))
    marked = lambda: "gruxof" + word()
    text = lambda share, n: " ".join((marked() if rng.random() < share else word()) + "." * (rng.random() < 0.1) for _ in range(n))
    docs = [(i, text(0.04 if i % 5 == 0 else 0.0033, 200), "s", "p", int(i % 5 == 0)) for i in range(600)]
    df = spark.createDataFrame(docs, SCHEMA)
    model = train_toxicity(df.where("doc_id < 400"), df.select("doc_id", "toxic"))
    got = {r.doc_id: r.score >= 0.5 for r in score_toxicity(df.where("doc_id >= 400"), model).collect()}
    assert np.mean([got[d[0]] for d in docs[400:] if d[4]]) >= 0.9 and np.mean([got[d[0]] for d in docs[400:] if not d[4]]) <= 0.03
    assert (scores(spark, model, ["gruxoflane"], "su em {} daro ti nela. " + "or ti sune la. " * 30) < 0.5).all()


def slow_score(model, text):
    """The score of a text by the explicit kernel feature map of each word and every stretch of sentences."""
    sums = []
    for s in sentences(text or ""):
        held = 0.0
        for w in units(s):
            letters = "".join(c for c in w if c.isalpha())
            margin = FLOOR
            if len(letters) > LONGEST:
                margin = float(model.words([w])[0])
            elif letters:
                codes = [27, *(1 + ord(c) - 97 if "a" <= c <= "z" else 29 + ord(c) % 35 for c in letters), 28]
                phi = {}
                for i, j, k in itertools.combinations(range(len(codes)), 3):
                    if k - i <= SPAN:
                        t = (codes[i] * 64 + codes[j]) * 64 + codes[k]
                        phi[t] = phi.get(t, 0) + GAP_PRICE ** (k - i - 2)
                margin = model.bias + sum(v * model.table[t] for t, v in phi.items()) / max(1e-6, sum(v * v for v in phi.values())) ** 0.5
            if margin > 0:
                held += model.weights[kernel([w], model.landmarks)[0].argmax(), sum(margin >= x for x in STEPS)]
        sums.append(held - model.rate * len(units(s)))
    best = max([0.0, *(sum(sums[i:j]) for i in range(len(sums)) for j in range(i + 1, len(sums) + 1))])
    return float(model.score(np.array([best]))[0])


def test_query(spark, data_dir):
    got = op6_toxicity(spark, data_dir).collect()
    assert len(got) == spark.read.parquet(f"{data_dir}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    docs, labels = (spark.read.parquet(f"{data_dir}/{t}.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0") for t in ("documents", "labels"))
    model = train_toxicity(docs, labels)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    for r in got[::4]:
        if len(texts[r.doc_id] or "") < 3000:
            assert r.score == pytest.approx(slow_score(model, texts[r.doc_id]) if model else 0.0, abs=1e-6)


def test_held_out_rows_of_every_language(spark):
    """On sf0.1: nine of ten toxic documents are found, eight of ten in each language, and of clean ones not one in a hundred is taken."""
    at = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    rest = "crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"
    model = train_toxicity(docs.where(rest), labels.where(rest))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in score_toxicity(docs.where(f"not ({rest})"), model, keep=("lang",)).collect() if truth.get(r.doc_id) is not None]
    found = {}
    for r in held:
        if truth[r.doc_id] == 1:
            found.setdefault(r.lang, []).append(r.score >= 0.5)
    assert np.mean(sum(found.values(), [])) >= 0.9
    assert {k: np.mean(v) for k, v in found.items() if len(v) >= 10 and np.mean(v) < 0.8} == {} and len(found) >= 4
    assert np.mean([r.score >= 0.5 for r in held if truth[r.doc_id] == 0]) <= 0.01
    insults = ["idiot", "stupid", "moron", "loser", "clown", "scum", "trash", "worthless", "pathetic"]
    weigh = lambda words: model.weigh(words) > 2
    assert weigh(insults).all() and weigh([w[:k] + w[k] + w[k:] for w in insults for k in range(len(w))]).all()
    assert weigh([w[:k] + c + w[k:] for w in insults for k in range(1, len(w)) for c in "aeqsxz"]).mean() > 0.9


def test_the_sample_is_of_rows(spark):
    """One id on half of the rows, and a text on a third of them, take no more of the sample than their share of distinct texts."""
    rows = [(7 if k % 2 else k, "same" if k % 3 == 0 else f"text {k}", "s", "p", 1) for k in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(2000)], "doc_id long, toxic int")
    drawn, totals = drawn_rows(df, labels, "doc_id", "text", "toxic", 50, 11)
    got = drawn.collect()
    assert len(got) == 100 and len({r.text for r in got}) == 100 and sum(totals.values()) == len({r[1] for r in rows})
    assert sorted(map(tuple, got)) == sorted(map(tuple, drawn_rows(df.repartition(7), labels, "doc_id", "text", "toxic", 50, 11)[0].collect()))


def test_edges(spark):
    texts = [None, "", "  ", "...", "bad! bad", "good thing", "漢字 é", "x" * 5000 + " bad", "bad " * 50_000, "12 34"]
    df = spark.createDataFrame([(i, t, "s", "p", int("bad" in (t or ""))) for i, t in enumerate(texts)] + [(None, "bad", None, None, 1)], SCHEMA)
    model = train_toxicity(df, df.select("doc_id", "toxic").unionByName(df.select("doc_id", "toxic")))
    got = score_toxicity(df, model).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score == got[2].score == got[3].score
    assert train_toxicity(df.limit(0), df.select("doc_id", "toxic")) is None
    assert {r.score for r in score_toxicity(df, None).collect()} == {0.0}
    assert score_toxicity(df.limit(0), model).collect() == [] and fit([], (0, 0)) is None
