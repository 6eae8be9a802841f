"""Personal data: base spans against the plain patterns, and what the field adds."""

import hashlib
import re
import time

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.llm import pii

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = []
    for kind, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            good = True
            if kind == 1:
                good = all(int(x) <= 255 for x in m[0].split("."))
            elif kind == 2:
                twice = [int(c) * (1 + i % 2) for i, c in enumerate(d[::-1])]
                good = 16 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
            elif kind == 3:
                good = 8 <= len(d) <= 15
            if good:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text("aZ09.@+-_ %()é\n2", max_size=60) | st.from_regex("|".join(PLAIN)))
def test_base_equals_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in pii.op6_pii(spark, d).collect()}
    for doc, text in duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall():
        base, r = plain(text), rows[doc]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(pii.written(base).split(",")) <= set(r.spans.split(","))


def test_field_keeps_labels_alike(spark):
    lines = ["Call +1 (555) 010-4477 today, or 555 010 4477 at night.", "Mail jo@ex.org or jo (at) ex (dot) org.", "Order 1234 5678 9012 3456 is not a card.", "Rows 20200101 and 20200102."]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines * 30)], "doc_id long, text string")
    field = pii.trained(docs)
    got = {t: pii.all_spans(t, field) for t in lines}
    texts = {t: {(pii.KINDS[k], t[s:e]) for k, s, e in every} for t, (_, every) in got.items()}
    assert texts[lines[0]] == {("phone", "+1 (555) 010-4477"), ("phone", "555 010 4477")}
    assert texts[lines[1]] == {("email", "jo@ex.org"), ("email", "jo (at) ex (dot) org")}
    assert texts[lines[2]] == texts[lines[3]] == set()


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a" * 200_000), (3, "1" * 200_000), (None, "x@y.z é 1.2.3.4"), (4, "+1" + "2 " * 100_000), (5, "a@" * 50_000), (6, "1.2.3.4 " * 20_000 + "1 2 3 4 5 6 7 8 9")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, spans string")
    began = time.time()
    out = pii.found(df, pii.trained(df), masked=True).collect()
    assert time.time() - began < 60 and len(out) == 8
    by = {r.doc_id: r for r in out}
    assert by[1].spans == by[2].spans == "" and by[1].masked is None
    assert by[None].spans == "email:0:5,ip:8:15" and by[None].masked == "<EMAIL> é <IP>"
    assert by[6].n_ip == 20_000
    assert pii.found(df.where("false"), pii.trained(df.where("false"))).count() == 0


def test_messages_equal_enumeration():
    """Exact where links make no loop; the same labels where they do."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    labels = len(pii.KINDS) + 1
    for names in (["a", "b", "c"], ["a"], ["111111111", "b", "c", "d"], ["x@y.z", "b", "x@y.z"], ["a", "a", "b", "a"]):
        field = pii.Field(rng.normal(size=(16, labels)), 0.3 * rng.normal(size=(labels, labels)), 2.0, 1.0)
        x, known = rng.integers(0, 2, (len(names), 16)).astype(float), np.array([-1] * len(names))
        known[-1] = 2
        unary, links = field.graph(x, known, names)
        p = np.zeros((len(names), labels))
        for y in itertools.product(range(labels), repeat=len(unary)):
            weight = np.exp(sum(unary[i, k] for i, k in enumerate(y)) + sum(m[y[a], y[b]] for a, b, m in links))
            for i in range(len(names)):
                p[i, y[i]] += weight
        p /= p.sum(axis=1, keepdims=True)
        got = field.label(x, known, names)
        if len(set(names)) == len(names):
            assert np.allclose(got, p, atol=1e-4)
        assert (got.argmax(axis=1) == p.argmax(axis=1)).all()


def test_potentials_are_learned(spark):
    """Equal and similar tokens draw each other as strongly as the texts teach; without a lesson nothing is added."""
    lines = ["Call +1 (555) 010-4477 today, or 555 010 4477 at night, 555.010.4477 too.", "Mail jo@ex.org or jo (at) ex (dot) org.", "Rows 20200101 and 20200102."]
    field = pii.trained(spark.createDataFrame([(i, x) for i, x in enumerate(lines * 20)], "doc_id long, text string"))
    assert field.equal > 1
    assert pii.all_spans("Rows 20190101 of it", field) == ([], [])
    # without a find in the same text: what a candidate looks like decides
    assert pii.all_spans("write to ann (at) ex (dot) org now", field) == ([], [(0, 9, 30)])
    nothing = pii.trained(spark.createDataFrame([(1, "no tokens")], "doc_id long, text string"))
    assert pii.all_spans(lines[0], nothing)[1] == pii.base_spans(lines[0])


def test_candidates_of_any_length():
    text = "x " + "1 2-" * 5000 + "3 and " + "a" * 5000 + " (at) " + "b" * 300 + " (dot) c" * 40
    assert [e - s for s, e in pii.soft_spans(text, [])] == [4 * 5000 + 1, 5000 + 6 + 300 + 8 * 40]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "x@y.z", "p", 5, 6), (1, "x@y.z", "p", 5, 6)], "doc_id long, text string, masked string, n_ip long, spans int")
    out = pii.found(df, pii.trained(df), masked=True).collect()
    assert len(out) == 2 and all((r.n_email, r.n_ip, r.masked) == (1, 0, "<EMAIL>") for r in out)
    kept = pii.redacted(df, pii.trained(df)).collect()
    assert [tuple(r) for r in kept] == [(1, "<EMAIL>", "p", 5, 6)] * 2
