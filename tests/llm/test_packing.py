"""Packing against the tokenizer itself, and plans against their laws."""

import itertools
import math
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrymill.llm import base, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(rows):
    """Checks all rows' laws; returns how many sequences there are."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = packing.op5_packing(spark, d).collect()
    t = Tokenizer.from_file(PATH)
    want = {}
    for doc, text in duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall():
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[doc, k // 2048] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    total = sum(r.length for r in rows)
    assert whole(rows) <= math.ceil(total / 2048) + 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80), st.integers(60, 64))
def test_plan_laws(lengths, capacity):
    count = np.bincount(np.array(lengths, np.int64), minlength=capacity + 1)
    patterns = packing.plan(count, capacity)
    held = np.zeros(capacity + 1, np.int64)
    for items, n in patterns:
        assert n > 0 and sum(x * k for x, k in items) <= capacity
        for x, k in items:
            held[x] += n * k
    assert np.array_equal(held, count)
    first_fit = []
    for x in sorted(lengths, reverse=True):
        k = next((k for k, room in enumerate(first_fit) if room >= x), None)
        if k is None:
            first_fit.append(capacity)
            k = -1
        first_fit[k] -= x
    assert sum(n for _, n in patterns) <= len(first_fit) + 1


def test_exact_complements():
    count = np.zeros(101, np.int64)
    count[[60, 40, 50, 30, 20, 25]] = [3, 3, 4, 5, 5, 10]
    assert sum(n for _, n in packing.plan(count, 100)) == math.ceil((np.arange(101) * count).sum() / 100)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(1, 40), min_size=1, max_size=12), st.integers(1, 40))
def test_sums_equal_all_combinations(lengths, total):
    left = np.zeros(41, np.int64)
    left[list(lengths)] = 9
    got = [tuple(c) for c in packing.Sums(np.array(sorted(lengths)), 40).combinations(total, left)]
    want = {c for k in (2, 3) for c in itertools.combinations_with_replacement(sorted(lengths, reverse=True), k) if sum(c) == total}
    assert got[0] == (total,) and set(got[1:]) == want and len(got) == 1 + len(want)


def test_texts(spark):
    t = Tokenizer.from_file(PATH)
    known = packing.Words(PATH)
    for text in ["", " ", "É é à\n\tb", "don't I'LL  we've", "ΣΑΣ σ", "日本語 テスト", "a b c\x1cd\x85e", "x" * 5000, "<|endoftext|> 1234 ½ ⅷ", "hello <|endoftext|> world", "A<|endoftext|>b <|ENDOFTEXT|> <|endoftext", "it <|startoftext|>'s<|endoftext|><|endoftext|>é", "e ́ x", "İ ı ẞ", "👍🏽 ok"]:
        assert np.frombuffer(next(known.ids([text.encode()])), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("abzÀéßÿ÷ŒΣς'sdm19½!?&$#@^_`{|}~<>-/:[]\\ \n\t\u00a0\u0301é日"), max_size=40), max_size=5))
def test_any_texts(texts):
    t = Tokenizer.from_file(PATH) if not hasattr(test_any_texts, "t") else test_any_texts.t
    test_any_texts.t = t
    known = packing.Words(PATH, 5, 5) if not hasattr(test_any_texts, "w") else test_any_texts.w
    test_any_texts.w = known
    got = [np.frombuffer(x, "<u4").tolist() for x in known.ids([x.encode() for x in texts])]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (4, "a b"), (4, "a b"), (None, "c")]
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, length long, offset long")
    clash = spark.createDataFrame([(1, 2000, 5, "x", 3, 7), (2, 48, 6, "y", 4, 8)], "doc_id long, length long, _l long, r string, rank long, _rank long")
    assert sorted((r.doc_id, r._l, r.r, r.rank, r._rank, r.offset) for r in packing.packed(clash, ["doc_id"]).collect()) == [(1, 5, "x", 3, 7, 0), (2, 6, "y", 4, 8, 2000)]
    out = packing.packed(packing.pieces(df, PATH), ["doc_id", "piece", "ids_crc32"]).collect()
    assert sorted(r.length for r in out) == sorted([1, 1, 2048, 2048, 905, 3, 3, 2])
    whole(out)
    assert packing.packed(packing.pieces(df.where("false"), PATH), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        packing.packed(spark.createDataFrame([(1, 3000)], "doc_id long, length long"), ["doc_id"])


def test_runs_of_a_hot_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 50)
    df = spark.createDataFrame([(i, 700 if i % 3 else 648) for i in range(900)], "doc_id long, length long")
    assert whole(packing.packed(df, ["doc_id"]).collect()) == 300


def test_words_are_forgotten(spark):
    """Workers that outlive packing's tasks don't keep its memories through other operators' tasks."""
    docs = spark.createDataFrame([(i, f"some word{i} here") for i in range(50)], "doc_id long, text string").coalesce(1)
    assert packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 50
    left = base.mapped(docs, ["doc_id"], "n long", lambda batch: iter([{"n": [packing.words.cache_info().currsize]}]))
    assert [r.n for r in left.collect()] == [0]


def test_lookups_of_many_texts(monkeypatch):
    """Ids don't depend on how many texts are looked up at a time; closing signs stay with what isn't a letter."""
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [b"", b"End. Of, it; 5, x.. y.\n", b"a, b.", b".", b"no\x0bend!\tq?", "é, ü. ß:".encode(), b"w. " * 300, b"A,b, C.d."] * 3
    known = packing.Words(path)
    want = [np.array(known.tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for most, size in ((1, 1 << 20), (512, 1), (512, 1 << 20)):
        monkeypatch.setattr(packing, "TEXTS", most)
        monkeypatch.setattr(packing, "BYTES", size)
        assert list(packing.Words(path).ids(texts)) == want
