"""Interleaved documents: exact round trips, parsing and joins."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from quarrymill.llm import media


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = media.op9_media(spark, d).collect()
    want = {}
    for doc, text in duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall():
        raw = text.encode()
        payload = raw + b"\xff" * ((576 - len(raw) % 576) % 576 if raw else 576)
        want[doc] = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == want and len(rows) == len(want)
    stored = {hashlib.sha256(p).hexdigest(): p for p in (media.picture(media.padded(t.encode())) for (t,) in duckdb.sql(f"select text from '{d}/documents.parquet'").fetchall())}
    assert all(len(stored[r.media_sha256]) == r.media_bytes for r in rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a" * 576), (4, "a" * 577), (4, "a" * 577), (None, "é"), (5, "z" * 300_000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, digest string, ref string")
    own = media.stored(df)
    out = media.resolved(media.sequences(own, "doc_id", "page"), media.read_back(own)).where("kind = 'media'").collect()
    assert sorted((r.n_bytes, r.payload_bytes) for r in out) == [(0, 576), (0, 576), (2, 576), (576, 576), (577, 1152), (577, 1152), (300_000, 300_096)]
    assert len({tuple(r)[5:] for r in out if r.n_bytes == 0}) == 1
    assert media.read_back(media.stored(df.where("false"))).count() == 0


def test_picture():
    rng = np.random.default_rng(1)
    payload = rng.integers(0, 256, 576 * 3, dtype=np.uint8).tobytes()
    png = media.picture(payload)
    assert media.samples(png).tobytes() == payload and media.samples(png).shape == (3, 576)
    with pytest.raises(ValueError):
        media.samples(png[:40] + bytes([png[40] ^ 1]) + png[41:])
    with pytest.raises(ValueError):
        media.samples(b"GIF89a")


def test_parsed():
    page = """<html><head><title>T &amp; x</title><script>var t="</p><img src=no>";</script></head><body><p>One <b>bold</b>
    word</p><figure><img src='a.png' alt="A"><figcaption>Cap &lt;1&gt;</figcaption></figure>tail<!-- <img src=c> --><img src=b.png alt="B&quot;"><p>end"""
    assert media.parsed(page) == [(0, "text", "T & x", None), (1, "text", "One bold word", None), (2, "media", "Cap <1>", "a.png"), (3, "text", "tail", None), (4, "media", 'B"', "b.png"), (5, "text", "end", None)]
    assert media.parsed("") == [] and media.parsed("<p></p>") == [] and media.parsed("a < b") == [(0, "text", "a < b", None)]
    assert media.parsed("<script>x") == [] and media.parsed("<img><img src=>") == []


def test_pages_resolve(spark):
    pages = spark.createDataFrame([(1, "<p>x</p><img src='d1' alt='one'><img src='d2'>"), (2, "<img src='d1'>"), (3, None)], "page_id long, html string")
    store = spark.createDataFrame([("d1", b"abc")], "digest string, media binary")
    rows = media.resolved(media.sequences(pages, "page_id", "html"), store).collect()
    assert sorted((r.id, r.position, r.kind, r.text, r.ref, r.media and bytes(r.media)) for r in rows if r.kind == "media") == [(1, 1, "media", "one", "d1", b"abc"), (1, 2, "media", None, "d2", None), (2, 0, "media", None, "d1", b"abc")]
    assert len(rows) == 4


def test_captions():
    assert media.parsed("<figure><img src=a><figcaption><p>One</p><p>two</p></figcaption></figure>x") == [(0, "media", "One two", "a"), (1, "text", "x", None)]
    assert media.parsed("<figure><figcaption>Lead<img src=a alt=q></figcaption></figure>") == [(0, "media", "Lead", "a")]
    assert media.parsed("<figure><img src=a><figcaption>open</figure><figure><img src=b alt=B>body</figure>") == [(0, "media", "open", "a"), (1, "media", "B", "b"), (2, "text", "body", None)]
    assert media.parsed("<p>a</p><figure><figcaption>alone</figcaption><p>b</p></figure>c") == [(0, "text", "a", None), (1, "text", "alone", None), (2, "text", "b", None), (3, "text", "c", None)]
    assert media.parsed("<figure><img src=a><figure><img src=b><figcaption>in</figcaption></figure><figcaption>out") == [(0, "media", "out", "a"), (1, "media", "in", "b")]
    assert media.parsed("<figcaption>no figure</figcaption>") == [(0, "text", "no figure", None)]


def test_real_pages(spark):
    """All words of the tables' pages in order, as the standard library's parser gives them."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            own = dict(attrs)
            self.off += tag in ("script", "style")
            if tag in media.MEDIA and own.get("src"):
                self.words += (own.get("alt") or "").split()

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style")

        def handle_data(self, data):
            if not self.off:
                self.words += data.split()

    d = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{d}/pages.parquet")
    got = {r.id: " ".join(x.text for x in r["items"] if x.text) for r in media.sequences(pages, "page_id", "html").collect()}
    for page, text in duckdb.sql(f"select page_id, html from '{d}/pages.parquet'").fetchall():
        own = Plain()
        own.feed(text)
        assert "".join(got[page].split()) == "".join(own.words), page


def test_repeats_and_clashes(spark):
    df = spark.createDataFrame([(1, "a", 5, "p"), (1, "a", 6, "q")], "doc_id long, text string, id int, page string")
    own = media.stored(df)
    assert len(own.collect()) == 2 and len({r.digest for r in own.collect()}) == 1
    assert len(media.resolved(media.sequences(own, "doc_id", "page"), media.read_back(own)).where("kind = 'media' and n_bytes = 1").collect()) == 2
    assert media.sequences(df.where("false"), "doc_id", "page").count() == 0
