"""Order MinHash against a plain version of every step."""

import hashlib

import duckdb
import numpy as np

from quarrymill.llm import order_minhash as omh


def plain(text):
    """The k-mers hashed one by one, then for each row the two least in text order."""
    grams = omh.kmers(text.encode()).tolist()
    a, b = omh._factors(omh.ROWS)
    out = []
    for i in range(omh.ROWS):
        def value(k):
            h = (grams[k] * int(a[i]) & (1 << 64) - 1) ^ int(b[i])
            return h ^ h >> 32
        least = sorted(sorted(range(len(grams)), key=value)[: omh.TUPLE])
        x = np.full(1, 7, np.uint64)
        for k in [-1] * (omh.TUPLE - len(least)) + least:
            x = omh._mixed(x ^ (omh.NONE if k < 0 else np.uint64(grams[k])))
        out.append(int(x[0]) >> 32)
    return "".join(f"{v:08x}" for v in out) if grams else "0" * 8 * omh.ROWS


def brute(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        other = omh.edited(text, after)
        f, e, n = (omh.hexed(omh.sketch(omh.kmers(t.encode()))) for t in (text, other, after))
        near = [sum(f[k : k + 8] == x[k : k + 8] for k in range(0, len(f), 8)) / omh.ROWS for x in (e, n)]
        out.append((doc, len(text), hashlib.sha256(other.encode()).hexdigest(), f, e, *near))
    return sorted(out, key=str)


def test_query(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    assert sorted(map(tuple, omh.op8_order_minhash(spark, d).collect()), key=str) == brute(rows)
    few = omh.succession
    monkeypatch.setattr(omh, "succession", lambda docs: few(docs, rows=7))
    assert sorted(map(tuple, omh.op8_order_minhash(spark, d).collect()), key=str) == brute(rows)


def test_sketch_equals_plain(monkeypatch):
    monkeypatch.setattr(omh, "BLOCK", 7)
    for text in ["", " ", "a", "a b c d e", "a b c d e f", "x " * 40, "the quick brown fox jumps over the lazy dog and the quick brown fox sleeps"]:
        assert omh.hexed(omh.sketch(omh.kmers(text.encode()))) == plain(text)


def test_occurrences_and_order_count():
    def f(s):
        return omh.sketch(omh.kmers(s.encode()))
    a, b = "one two three four five six ", "red green blue black white grey "
    assert omh.likeness(f(a * 3 + b * 3), f(a * 3 + b * 3)) == 1
    assert omh.likeness(f(a * 3 + b), f(a + b * 3)) < 1
    assert omh.likeness(f(a * 20 + b * 20), f(b * 20 + a * 20)) < 0.8
    words = [f"w{i}" for i in range(400)]
    near, far = words.copy(), words.copy()
    near[10] = "x"
    far[::3] = ["y"] * len(far[::3])
    assert omh.likeness(f(" ".join(words)), f(" ".join(near))) > 0.8 > omh.likeness(f(" ".join(words)), f(" ".join(far)))


def test_edges(spark):
    rows = [(3, "a b c d e f g"), (3, "a b c d e f g"), (3, None), (None, "z z z"), (9, ""), (-4, "é" * 10), (7, "k " * 60_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int")
    assert sorted(map(tuple, omh.with_next(df).collect()), key=str) == brute(rows)
    assert sorted(map(tuple, omh.with_next(df.where("doc_id = 9")).collect()), key=str) == brute([(9, "")])
    assert omh.with_next(df.where("false")).count() == 0
