"""The Kneser-Ney model against a plain one, and its judgement against labels."""

import math
from collections import Counter

import duckdb
import pytest

from quarrymill.llm import kneser_ney as kn


class Plain:
    """Interpolated modified Kneser-Ney over some texts, by dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        top = Counter(g for t in texts for g in kn.grams(kn.plain(t), order))
        self.counts = {order: {g: c for g, c in top.items() if len(g) == order}}
        for k in range(order - 1, 0, -1):
            own = Counter(g[1:] for g in self.counts[k + 1])
            own.update({g: c for g, c in top.items() if len(g) == k})
            self.counts[k] = dict(own)
        self.symbols = len(self.counts[1]) + 1
        self.d, self.sums = {}, {}
        for k, own in self.counts.items():
            n1, n2, n3, n4 = (sum(c == i for c in own.values()) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            d = [i - (i + 1) * y * b / a if a and b else 0.5 + 0.25 * (i - 1) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
            self.d[k] = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]
            for g, c in own.items():
                total, spared = self.sums.get((k, g[:-1]), (0, 0.0))
                self.sums[k, g[:-1]] = total + c, spared + min(c, self.d[k][min(c, 3) - 1])

    def p(self, g):
        if not g:
            return 1 / self.symbols
        k = len(g)
        total, spared = self.sums.get((k, g[:-1]), (0, 0.0))
        if not total:
            return self.p(g[1:])
        c = self.counts[k].get(g, 0)
        return (c - min(c, self.d[k][min(c, 3) - 1]) if c else 0) / total + spared / total * self.p(g[1:])

    def perplexity(self, text):
        logs = [math.log(self.p(g)) for g in kn.grams(kn.plain(text), self.order)]
        return len(logs), math.exp(-sum(logs) / len(logs)) if logs else 1.0


@pytest.mark.parametrize("order", [2, 4])
def test_equals_plain(spark, sf, order):
    rows = duckdb.sql(f"select doc_id, text, lang from '{sf}/documents.parquet' limit 60").fetchall() + [(901, None, None), (902, "", "en"), (903, "Ω ≈ \x02\x03", "xx"), (903, "Ω ≈ \x02\x03", "xx"), (None, "the", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    trusted = [d for d, _, _ in rows if d is not None and d % 3 == 0 and d < 900]
    plain = Plain([t for d, t, _ in rows if d in trusted], order)
    got = kn.perplexities(docs, spark.createDataFrame([(d,) for d in trusted * 2], "doc_id long"), order, chars=20_000).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _, _ in rows)
    by = {d: (t or "", lang) for d, t, lang in rows}
    for r in got:
        n, p = plain.perplexity(by[r.doc_id][0])
        assert r.n_symbols == n and math.isclose(r.perplexity, p, rel_tol=1e-9) and r.lang == by[r.doc_id][1] and r.trusted == (r.doc_id in trusted)
    if order == 4:
        seen = {g[:-1] for g in plain.counts[3]}
        for h in list(seen)[:20]:  # what follows a context sums to one
            assert math.isclose(sum(plain.p(h + w) for w in plain.counts[1]) + plain.p(h + "∞"), 1.0, rel_tol=1e-9)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = kn.op10_kneser_ney(spark, d).collect()
    label = {i: (q, t) for i, q, t in duckdb.sql(f"select doc_id, quality, toxic from '{d}/labels.parquet'").fetchall()}
    assert len(rows) == 1000
    good = [r.keep for r in rows if label.get(r.doc_id, (0,))[0] == 1]
    bad = [r.keep for r in rows if label.get(r.doc_id, (1,))[0] == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.5


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 0), (2, None, None, 0), (None, "c", "en", 0), (1, "a b", "en", 0)], "doc_id long, text string, lang string, keep int")
    for labels in ([], [(1, None), (None, 1)], [(1, 1), (1, 1)]):
        out = kn.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(out) == 4 and (labels and labels[0][1] or all(r.keep for r in out))
    assert kn.judged(docs.where("false"), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def test_order_of_words_counts(spark, sf):
    rows = duckdb.sql(f"select doc_id, text, lang from '{sf}/documents.parquet' limit 60").fetchall()
    turned = [(1000 + d, " ".join((t or "").split()[::-1]), lang) for d, t, lang in rows]
    trusted = [d for d, _, _ in rows if d % 2 == 0]
    docs = spark.createDataFrame([*rows, *turned], "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r for r in kn.perplexities(docs, spark.createDataFrame([(d,) for d in trusted], "doc_id long"), 5, chars=20_000).collect()}
    long = [d for d in trusted if got[d].n_symbols > 200]
    assert long and all(got[1000 + d].perplexity > got[d].perplexity for d in long)


def test_windows(monkeypatch):
    texts = ["a b", "", "\ufffd é日\U0001f600 x", "aaaa a", "\0\0 b\0"] * 3
    want = [g for t in texts for g in kn.grams(t, 3)]
    for alphabet in (None, 1):
        own = kn.Windows(texts, 3)
        if alphabet:
            own.narrow = False  # as for an alphabet too large for a code
        assert own.strings(own.of(texts)) == want
        assert own.strings(own.distinct(texts)) and set(own.strings(own.distinct(texts))) == set(want)
    assert [x for s in kn.slices(texts, 5) for x in s] == texts


def test_signs_in_trusted_text(spark):
    """A text's own U+0002 and U+0003 are no ends."""
    docs = spark.createDataFrame([(1, "a\x02b b\x03", "en"), (2, "b", "en"), (3, "a\x02b", "en"), (4, "x " * 100_000, "en")], "doc_id long, text string, lang string")
    plain = Plain(["a\x02b b\x03", "b"], 3)
    got = {r.doc_id: r for r in kn.perplexities(docs, spark.createDataFrame([(1,), (2,)], "doc_id long"), 3).collect()}
    for r in docs.collect():
        assert math.isclose(got[r.doc_id].perplexity, plain.perplexity(r.text)[1], rel_tol=1e-9)


def test_threshold_is_a_quantile(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    good = docs.selectExpr("doc_id", "1 as quality")
    by: dict = {}
    for r in kn.judged(docs, good).collect():
        by.setdefault(r.lang, []).append(r)
    for rows in by.values():  # a threshold is the perplexity of one of the trusted documents, not beyond them
        assert len({r.threshold for r in rows}) == 1 and rows[0].threshold in {r.perplexity for r in rows}
