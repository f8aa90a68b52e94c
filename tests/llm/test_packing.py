import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from patchloom.llm.packing import CAPACITY, cuts, op4_packing, pack_documents

SCHEMA = "doc_id long, text string, start int, length string, class string"


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(pieces, docs, ids_of):
    """Every id once, gapless offsets, nothing over the capacity; returns the share of padding."""
    sequences, parts = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        parts.setdefault(p.doc_id, []).append(p)
    used = padded = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= CAPACITY
        used += at
        padded += at if at & (at - 1) == 0 else CAPACITY
    assert parts.keys() == {i for i, _ in docs}
    for i, text in docs:
        ids = np.array(ids_of(text or "") + [1], "<u4")
        at = 0
        for p in sorted(parts[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    return 1 - used / padded


def test_cuts():
    for n in range(1, 5000):
        got = cuts(n)
        assert sum(length for length, _ in got) == n
        assert all(k == CAPACITY // length and k * length <= CAPACITY for length, k in got)


def test_query(spark, data_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    t = tokenizer()
    assert check(op4_packing(spark, data_dir).collect(), docs, lambda x: t.encode(x, add_special_tokens=False).ids) < 0.03


def test_ids_equal_the_tokenizers_library(spark):
    rng = random.Random(3)
    odd = ["", " ", "  a  b ", "\n\n \t x", "it's I'LL we've ' s", "<|endoftext|>", "x<|endoftext|>y", "a  <|endoftext|>  b\n<|endoftext|><|endoftext|>", "<|endoftext |> <|endof", "x²½ ⅷ 12 3", "漢字かな 🎉🎉", "a b c\x1cd\x85e", "é́ñ", "_" * 300, "a" * 3000]
    docs = [(k, x) for k, x in enumerate(odd)] + [(100 + k, "".join(rng.choices("ab '\n\t.1é漢_s ", k=rng.randint(1, 400)))) for k in range(200)]
    rows = spark.createDataFrame([(i, x, 1, "x", None) for i, x in docs], SCHEMA).repartition(3)
    got = pack_documents(rows).selectExpr("doc_id", "start", "length", "crc32(ids) ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
    t = tokenizer()
    check(got, docs, lambda x: t.encode(x, add_special_tokens=False).ids)


def test_edges(spark):
    rows = spark.createDataFrame([(None, None, 1, "x", None), (1, "", 1, "x", None), (2, "a b", 1, "x", None), (2, "a b", 1, "x", None)], SCHEMA)
    got = pack_documents(rows).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == [("1", 1), ("2", 3), ("2", 3), ("None", 1)]
    assert pack_documents(spark.createDataFrame([], SCHEMA)).collect() == []
