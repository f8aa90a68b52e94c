import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patchloom.llm.fingerprint import Fingerprinter, edited_fingerprints, fingerprint_documents, hexed, likeness, op2_lz_fingerprint

SCHEMA = "doc_id long, text string, id long, guest int, range string"


def phrases(text):
    out, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in out:
            out.add(text[start:end])
            start = end
    return out | ({text[start:]} if start < len(text) else set())


def brute(docs):
    docs = sorted(((i, t or "") for i, t in docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    maker, out = Fingerprinter(), []
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = maker.one(t), maker.one(edited), maker.one(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


@settings(deadline=None, max_examples=60)
@given(st.text("abé🎉 ", max_size=80), st.text("abé🎉 ", max_size=80))
def test_signature_is_of_the_phrase_sets(a, b):
    maker = Fingerprinter(10_000)
    x, y = phrases(a), phrases(b)
    want = len(x & y) / len(x | y) if x | y else 1.0
    assert likeness(maker.one(a), maker.one(b), 10_000) == pytest.approx(want)
    edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
    assert [hexed(s) for s in maker.pair(a, edited)] == [hexed(maker.one(a)), hexed(maker.one(edited))]


def test_query(spark, data_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op2_lz_fingerprint(spark, data_dir).collect()), key=str) == brute(docs)


def test_edges_over_many_ranges(spark):
    docs = [(k // 2, "ab" * (k % 9) + "é🎉" * (k % 5)) for k in range(90)] + [(3, None), (None, "xyz"), (None, None), (7, ""), (500, "long " * 4000), (501, "long " * 4000)]
    df = spark.createDataFrame([(i, t, 1, 1, "x") for i, t in docs], SCHEMA).repartition(3)
    for per_range in (1, 7, 1000):
        assert sorted((tuple(r) for r in edited_fingerprints(df, per_range=per_range).collect()), key=str) == brute(docs)
    assert sorted((r.fingerprint for r in fingerprint_documents(df).collect())) == sorted(x[3] for x in brute(docs))


def test_single_and_empty(spark):
    one = spark.createDataFrame([(1, "abc", 1, 1, "x")], SCHEMA)
    assert [tuple(r) for r in edited_fingerprints(one).collect()] == brute([(1, "abc")])
    assert edited_fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
