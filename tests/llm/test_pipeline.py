import re

import corpus_pipeline
from tests.llm.test_mixing import brute_targets
from tests.llm.test_ngram_join import brute
from tests.llm.test_secrets import base

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    columns, outs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, data_dir), name)
        outs.append(docs.collect())
        if name != "packing":
            assert docs.columns == columns
    start = spark.read.parquet(f"{data_dir}/documents.parquet").collect()
    good, single, clean, mixed, pieces = outs
    assert 0.7 * len(start) < len(good) < len(start) and {tuple(r) for r in good} < {tuple(r) for r in start}
    groups = brute([(r.doc_id, r.text) for r in good])
    assert sorted(r.doc_id for r in single) == sorted(i for i, _, c, _ in groups if i == c)
    assert {r.doc_id for r in clean} == {r.doc_id for r in single}
    texts = {r.doc_id: r.text for r in single}
    for r in clean:
        assert len(r.text) == r.n_chars and not [s for s in base(r.text) if s[3] != "assign"]
        if not base(texts[r.doc_id]) and "[SECRET]" not in r.text:
            assert r.text == texts[r.doc_id]
    _, want = brute_targets([(r.doc_id, r.text, r.source) for r in clean])
    words: dict = {}
    for r in mixed:
        words[r.source] = words.get(r.source, 0) + len(WORD.findall(r.text))
    assert all(abs(words.get(s, 0) - t) <= 1 for s, t in want.items())
    assert {p.doc_id for p in pieces} == {r.doc_id for r in mixed}
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)


def test_odd_rows(spark, data_dir):
    schema = spark.read.parquet(f"{data_dir}/documents.parquet").schema
    odd = [(None, None, None, None, None), (None, "a b", None, None, 3), (None, "a b", None, None, 3), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "token = 'abcdefgh12' é", None, "t", None), (4, "the end of the line of " * 3000, "en", None, 1)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[1:]:
            docs = corpus_pipeline.stored(stage(spark, docs, data_dir), name)
            n = docs.count()
            assert n or not rows


def test_run(spark, data_dir):
    assert corpus_pipeline.run(spark, data_dir).count() > 0


def test_repeated_and_null_ids_are_grouped_by_text(spark, data_dir):
    schema = spark.read.parquet(f"{data_dir}/documents.parquet").schema
    copy, alone, near = (" ".join(f"{w}{k}" for k in range(60)) for w in ("c", "a", "n"))
    rows = [(3, copy), (5, copy), (5, alone), (None, near), (None, near + " more"), (None, copy), (7, "x y"), (7, "other words"), (8, ""), (8, ""), (9, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    got = corpus_pipeline.near_duplicates(spark, docs.repartition(3), data_dir).collect()
    assert sorted((str(r.doc_id), r.text) for r in got if r.text and not r.text.startswith("n")) == sorted([("3", copy), ("5", alone), ("7", "x y"), ("7", "other words")])
    assert [r.doc_id for r in got if r.text and r.text.startswith("n")] == [None]
    assert sorted((str(r.doc_id), r.text) for r in got if not r.text) == [("8", ""), ("9", ""), ("None", None)]
