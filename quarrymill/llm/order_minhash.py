"""Order MinHash fingerprints, sensitive to edit distance, and the order of documents that the edited texts need."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.base import arrow_schema, table

#: Words a k-mer has, k-mers a tuple has, tuples a fingerprint has.
K, TUPLE, ROWS = 5, 2, 32
#: k-mers hashed at once for all rows, to bound memory over long texts.
BLOCK = 1 << 14
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Hashes(dict):
    """Words to 64-bit hashes; of bounded size."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 1)
        if len(word) <= 64:
            if len(self) >= 400_000:
                self.clear()
            self[word] = h
        return h


@cache
def _known() -> Hashes:
    return Hashes()


@cache
def _factors(rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8)
    return rng.integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, rows, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(text: bytes, k: int = K) -> np.ndarray:
    """Hashes of the text's k-mers of words in text order, each with the number of its occurrence so far.

    Words are what stands between ASCII blanks. Fewer words than k: the whole sequence is the only k-mer; none: no k-mers.
    """
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_known().__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    grams = np.full(n, len(h) if len(h) < k else k, np.uint64)
    for i in range(min(k, len(h))):
        grams = (grams ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
    order = np.argsort(grams, kind="stable")
    same = grams[order]
    first = np.concatenate([[True], same[1:] != same[:-1]])
    if not first.all():
        at = np.arange(n)
        seen = np.empty(n, np.uint64)
        seen[order] = at - np.maximum.accumulate(np.where(first, at, 0))
        grams = grams + seen * np.uint64(0xD6E8FEB86659FD93)
    return _mixed(grams)


def sketch(grams: np.ndarray, rows: int = ROWS, size: int = TUPLE) -> np.ndarray:
    """For each row's own order, the `size` least numbered k-mers, put back into text order, hashed as a tuple (32 bits)."""
    if not len(grams):
        return np.zeros(rows, np.uint32)
    a, b = _factors(rows)
    best = np.full((rows, size), NONE)
    where = np.full((rows, size), -1)
    each = np.arange(rows)
    for start in range(0, len(grams), BLOCK):
        part = grams[start : start + BLOCK]
        h = part[None, :] * a[:, None]
        h ^= b[:, None]
        h ^= h >> np.uint64(32)
        for _ in range(min(size, len(part))):
            at = h.argmin(axis=1)
            low = h[each, at]
            h[each, at] = NONE
            worst = best.argmax(axis=1)
            better = low < best[each, worst]
            best[each[better], worst[better]] = low[better]
            where[each[better], worst[better]] = start + at[better]
    where.sort(axis=1)
    out = np.full(rows, 7, np.uint64)
    for i in range(size):
        out = _mixed(out ^ np.where(where[:, i] < 0, NONE, grams[where[:, i]]))
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of rows on which two fingerprints agree."""
    return float((a == b).mean())


def hexed(x: np.ndarray) -> str:
    return x.astype(">u4").tobytes().hex()


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for each row: 32 tuples of two 5-mers of words, 8 hex digits each. Equal texts have equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hexed(sketch(kmers(t or b""))) for t in texts], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last third (rounded down) replaced by as many first code points of the following one, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


#: Buckets at most, so that what their bounds take on the driver and in tasks doesn't grow; larger buckets are sorted on disk and read through.
BUCKETS = 20_000


def succession(docs: DataFrame, rows: int = 4096) -> DataFrame:
    """(bucket, guest, doc_id, text) with each bucket's rows in descending doc_id and, after them, the first row of the next
    bucket as a guest; the last bucket's guest is the very first row.

    Buckets are ranges between doc_ids that occur, taken at approximate quantiles, so the first row of a bucket is known by
    its doc_id alone. Nulls count as less than any doc_id. One shuffle; there are at most BUCKETS buckets.
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, highest = own.agg(F.count("*"), F.max("key")).first()
    parts = max(1, min(BUCKETS, math.ceil((n or 0) / rows)))
    cuts = docs.where("doc_id is not null").select(F.col("doc_id").cast("double").alias("q")).approxQuantile("q", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    # as doubles, ids above 2**53 are rounded: a cut must be an id that occurs
    near = spark.createDataFrame([(float(x),) for x in sorted(set(cuts))] or [(0.0,)], "q double")
    exact = sorted({r.key for r in own.select("key", F.col("key").cast("double").alias("q")).join(F.broadcast(near), "q").groupBy("q").agg(F.max("key").alias("key")).collect()} | ({highest} if n else set()))
    bounds = np.array(exact, np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy()
            bucket = len(bounds) - 1 - np.searchsorted(bounds, key, side="left")
            first = np.nonzero(bounds[len(bounds) - 1 - bucket] == key)[0]
            for rows_, to, guest in ((np.arange(len(key)), bucket, 0), (first, (bucket[first] - 1) % len(bounds), 1)):
                if len(rows_):
                    taken = b.take(pa.array(rows_))
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.full(len(to), guest), pa.int32()), taken.column("key"), taken.column("doc_id"), taken.column("text")], ["bucket", "guest", "key", "doc_id", "text"])

    spread = own.mapInArrow(dealt, "bucket int, guest int, key long, doc_id long, text string")
    return spread.repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("key").desc(), "text").select("bucket", "guest", "doc_id", "text")


def with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document in descending doc_id.

    Nulls: a null text is empty; rows with a null doc_id come last. Repeated doc_ids follow each other by text; the last row
    is followed by the first, a single row by itself. An empty text's fingerprint is all zeros. An empty table gives no rows.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, False  # the row that waits for the next one of its bucket

        def one(doc: int | None, text: str, own: np.ndarray, following: str, then: np.ndarray) -> tuple:
            other = edited(text, following)
            data = other.encode()
            changed = own if other == text else sketch(kmers(data))
            return doc, len(text), hashlib.sha256(data).hexdigest(), hexed(own), hexed(changed), likeness(own, changed), likeness(own, then)

        for b in batches:
            rows = []
            for bucket, guest, doc, text in zip(*[b.column(i).to_pylist() for i in range(4)]):
                if held is not None and held[0] == bucket and done:
                    continue  # further copies of a guest
                if held is not None and held[0] != bucket:
                    held, done = None, False
                own = sketch(kmers(text.encode()))
                if held is not None:
                    rows.append(one(*held[1:], text, own))
                held, done = (bucket, doc, text, own), bool(guest)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return succession(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, schema)


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: see with_next."""
    return with_next(table(spark, sf_dir, "documents"))
