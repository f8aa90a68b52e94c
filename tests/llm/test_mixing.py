import re
from collections import Counter, defaultdict

import pytest

from patchloom.llm.mixing import BLOCK_WORDS, mix_sources, mixed_documents, op5_mixing, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size string"


def test_targets():
    assert targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert targets([10, 100, 1000], [5, 2, 1]) == [30.0, 300.0, 780.0]
    assert targets([0, 0], [5, 2]) == [0.0, 0.0]
    assert targets([], []) == []


def brute_targets(docs):
    size = defaultdict(int)
    for _, text, source in docs:
        size[source] += len(WORD.findall(text or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    left, share, full = sum(size.values()), {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}, {}
    while True:
        w = sum(share[s] for s in names if s not in full)
        over = [s for s in names if s not in full and left * share[s] / w > 3 * size[s]]
        if not over:
            return size, full | {s: left * share[s] / w for s in names if s not in full}
        for s in over:
            full[s] = 3 * size[s]
            left -= full[s]


def test_query(spark, data_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    size, want = brute_targets(docs)
    got = op5_mixing(spark, data_dir).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len(WORD.findall(t))) for i, t, _ in docs)
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, op5_mixing(spark, data_dir).collect()))


def test_schedule_is_even(spark, data_dir):
    mix = mix_sources(spark.read.parquet(f"{data_dir}/documents.parquet"))
    slots = sorted({(r.slot, r.source_no) for r in mix.schedule.select("slot", "source_no").collect()})
    total = Counter(s for _, s in slots)
    half = Counter(s for _, s in slots[: len(slots) // 2])
    for s, n in total.items():
        assert abs(half[s] - n / 2) <= 6
    for r in mix.schedule.groupBy("slot").sum("words").collect():
        assert r[1] <= BLOCK_WORDS


def test_edges(spark):
    rows = [(1, None, "en", "a", 0, "x", "y"), (2, "", None, "a", 0, "x", "y"), (3, "w " * 500, "en", None, 1, "x", "y"), (3, "w " * 500, "en", None, 1, "x", "y"), (None, "one two three", "en", "b", 1, "x", "y"), (5, "x y", "en", "Z", 1, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    mix = mix_sources(df)
    got = mix.rows.join(mix.taken, "row", "left").collect()
    assert len(got) == 6
    by = Counter()
    for r in got:
        assert (r.taken or 0) <= 3 * r["size"]
        by[r.source] += r.taken or 0
    _, want = brute_targets([(r[0], r[1], r[3]) for r in rows])
    assert all(abs(by[s] - t) <= 1 for s, t in want.items())
    empty = mix_sources(spark.createDataFrame([], SCHEMA))
    assert empty.rows.collect() == [] and empty.taken.collect() == []


def test_documents_of_the_mix(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    _, want = brute_targets([tuple(r) for r in docs.select("doc_id", "text", "source").collect()])
    words = Counter()
    for r in out.collect():
        words[r.source] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert all(abs(words[s] - t) <= 1 for s, t in want.items())
