import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from patchloom.llm.infill import OP12_SQL, FORMS, fill_in_middle, gathered, op12_fill_in_middle, restore_middle, scattered

SCHEMA = "doc_id long, text string, form string, output string, n int"


def slow(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = [None, "", " ", "a", "ab", "é", "漢字 kana 🎉", "<P>", "x<S>", "<M", "<P", "P>", "a<\nS>b", "<<P>>", "<p>", "@[`{az", "z" * 300, "\n\r\t ", "a b " * 200_000, "é" * 100_001, "no-mark <S >"]


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(k, TEXTS[k % len(TEXTS)]) for k in range(210)] + [(k, "".join(rng.choices("ab é<PSM>\n🎉", k=rng.randrange(60)))) for k in range(300, 700)]
    rows += [(None, "some words"), (None, None), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(i, t, "f", "o", 1) for i, t in rows], SCHEMA).repartition(3)
    got = restore_middle(fill_in_middle(df)).collect()
    key = lambda r: (str(r[0]), r[5], str(r[3]))
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((slow(*r) for r in rows), key=key)
    assert sorted(r.restored for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(df.limit(0)).collect() == []


def test_restoring_needs_the_output_and_form_alone(spark):
    df = spark.createDataFrame([("psm", "<P>a<S>c<M>b", 1), ("spm", "<S>c<P>a<M>b", 2), ("plain", "x<P>", 3), ("plain", None, 4), ("psm", "<P><S><M>", 5)], "form string, output string, restored int")
    assert [r.restored for r in restore_middle(df).collect()] == ["abc", "abc", "x<P>", "", ""]
    for bad in (("psm", "<P>a<S>c"), ("spm", "<P>a<S>c<M>b"), ("psm", "<P>a<S>c<M>b<M>")):
        data = np.frombuffer(bad[1].encode(), np.uint8)
        with pytest.raises(ValueError):
            gathered(data, np.array([0, len(data)]), np.searchsorted(FORMS, [bad[0]]))


def test_a_batch_is_the_same_as_its_texts_alone():
    texts = [t or "" for t in TEXTS[:18]] * 3
    array = pa.array(texts, pa.large_string())
    data, offsets = np.frombuffer(array.buffers()[2], np.uint8)[: sum(len(t.encode()) for t in texts)], np.frombuffer(array.buffers()[1], np.int64)[: len(texts) + 1]
    hashes = np.random.default_rng(1).integers(0, 1 << 32, (len(texts), 4))
    together = scattered(data, offsets, hashes)
    for k in range(len(texts)):
        alone = scattered(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]), hashes[k : k + 1])
        assert [int(x[0]) for x in alone[:4]] == [int(x[k]) for x in together[:4]]
        assert bytes(alone[4]) == bytes(together[4][together[5][k] : together[5][k + 1]])


def test_query(spark, data_dir):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").collect()
    want = sorted((*slow(r.doc_id, r.text)[:5], sha(slow(r.doc_id, r.text)[5]), sha(r.text or "")) for r in docs)
    got = sorted(map(tuple, op12_fill_in_middle(spark, data_dir).collect()))
    assert got == want
    with duckdb.connect() as con:
        con.sql(f"create view documents as select * from '{data_dir}/documents.parquet'")
        assert sorted(con.sql(OP12_SQL).fetchall()) == want
