"""Near copies by exact Jaccard similarity of word shingles, in clusters of which the best member is kept."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.base import cut, kept, mapped, swept, utf8
from quarrymill.operators.graphs import components

#: Words in a shingle; bands and rows a band (a pair at 0.8 shares no band once in 20,000, one at 0.85 once in three million).
WORDS, BANDS, ROWS = 5, 25, 5
#: Shingles hashed at once, so that a very long text needs little memory.
BLOCK = 1 << 13
#: Keys of sets (8 bytes each) that may be broadcast.
BROADCAST = 1_000_000
#: Standard deviations by which signs of two sets may differ more than those of sets at the threshold do on average. A pair at 0.8 is
#: beyond once in a million, far less often than it shares no band; beyond CHOSEN nodes a bucket and round, so many rows (band, node) may be open.
SPREAD, CHOSEN, OPEN = 5.5, 128, 2_000_000
#: Longs of 16 minima's last four bits each.
SIGNS = -(-BANDS * ROWS // 16)
#: Bits of the shortest odd sketch, and where it begins in a node's signs.
ODD, AT = 512, 2 + SIGNS
#: Bytes of a node that waits in a bucket, besides its signs; bytes of waiting nodes and of sets, pairs of signs and links up to which one
#: task joins or follows them: a round of a few thousand rows would else take as many tasks, files and shuffles as one of millions.
ROW, FEW_ROWS, FEW_SETS, FEW_PAIRS, FEW_LINKS = 48, 16 << 20, 64 << 20, 200_000, 1_000_000
_odd = np.random.default_rng(11).integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct XXH64 of a text's word shingles, sorted. A-Z is lower-cased; a word is a run of other bytes than blanks and 9-13.
    Fewer words than a shingle has: the whole sequence is the only shingle. No words: none."""
    w = text.lower().split()
    n = max(1, len(w) - words + 1) if w else 0
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(n)], np.uint64))


def minima(own: np.ndarray) -> np.ndarray:
    """The least of a set's hashes under each of BANDS x ROWS permutations."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), BLOCK):
        x = own[i : i + BLOCK] * _odd
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, x.min(axis=1))
    return least


def bands(own: np.ndarray, least: np.ndarray | None = None) -> list[int]:
    """A signed long for each band, equal where all of a band's minima are."""
    rows = (minima(own) if least is None else least).reshape(BANDS, ROWS)
    return [int(np.uint64(xxhash.xxh64_intdigest(r.tobytes(), k)).view(np.int64)) for k, r in enumerate(rows)]


def majority(h: np.ndarray) -> int:
    """SimHash of 64-bit hashes: bit i is 1 if it is set in over half of them; of none 0."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">u8")[0])


def signs(own: np.ndarray, least: np.ndarray) -> list[int]:
    """A set's size, its SimHash and the last four bits of its minima, as signed longs."""
    last = np.zeros(16 * SIGNS, np.uint64)
    last[: len(least)] = least & np.uint64(15)
    longs = (last.reshape(SIGNS, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)
    return [len(own), *np.concatenate([np.array([majority(own)], np.uint64), longs]).view(np.int64).tolist()]


def odd(own: np.ndarray) -> list[int]:
    """A set's odd sketch, as signed longs: bit i of m is the parity of the hashes that are i modulo m, a power of two, ODD at least and no
    less than the set's size. Members that two sets share cancel out, so their sketches differ in no more bits than the sets in members.
    A sketch of m bits, its halves xored, is that of m / 2."""
    m = max(ODD, 1 << (len(own) - 1).bit_length())
    bits = np.bincount((own & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def bounds(least: float) -> tuple[int, int]:
    """Differing bits of SimHashes and differing ends of minima beyond which two sets surely enough are less similar than `least`."""
    both = 2 * least / (1 + least)  # cosine of two sets of equal size; of others it is greater
    return tuple(math.ceil(n * q + SPREAD * math.sqrt(n * q * (1 - q))) for n, q in ((64, math.acos(min(1.0, both)) / math.pi), (BANDS * ROWS, (1 - least) * 15 / 16)))


def unshared() -> Column:
    """Bits in which the odd sketches of signs a and b differ, the longer one folded to the shorter: at least so many members are in one
    set only. 0 if one is over twice as long, as that of less than half the size."""
    n = F.least(F.size("a"), F.size("b")) - AT
    one = lambda side, i: F.get(side, i + AT).bitwiseXOR(F.coalesce(F.get(side, i + n + AT), F.lit(0).cast("long")))
    bits = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda sum_, i: sum_ + F.bit_count(one("a", i).bitwiseXOR(one("b", i))))
    return F.when(F.greatest(F.size("a"), F.size("b")) - AT <= 2 * n, bits).otherwise(0)


def alike(least: float) -> Column:
    """Whether signs a and b may be those of sets at `least` or more: sizes and odd sketches exactly, SimHashes and minima by their bounds."""
    bits, ends = bounds(least)
    a, b = (lambda i: F.col("a")[i]), (lambda i: F.col("b")[i])
    apart = F.lit(0)
    for i in range(2, AT):
        x = a(i).bitwiseXOR(b(i))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        apart = apart + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    near = F.least(a(0), b(0)) >= F.greatest(a(0), b(0)) * F.lit(least) - F.lit(1e-6)
    sure = unshared() <= (a(0) + b(0)) * F.lit((1 - least) / (1 + least)) + F.lit(1e-6)  # members that sets at `least` don't share
    return near & (F.bit_count(a(1).bitwiseXOR(b(1))) <= bits) & (apart <= ends) & sure


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _one(df: DataFrame, few: bool) -> DataFrame:
    """In one partition, which needs no shuffle for any join or sum, if it is few; else as it is."""
    return df.coalesce(1) if few else df


def _asked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Those of the rows whose key is among the keys. Up to BROADCAST keys are broadcast, so that only these rows are shuffled."""
    keys = keys.distinct()
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST else keys, "key", "left_semi")


def confirmed(pairs: DataFrame, sets: DataFrame, least: float, strict: bool, few: bool = False) -> DataFrame:
    """(u, v, near) for each of the pairs (u, v): whether they are at least so similar, or more than so if strict. few: in one task."""
    pairs = _one(pairs, few)
    found = _asked(sets, pairs.select(F.explode(F.array("u", "v")).alias("key")))
    found = _one(found.groupBy("key").agg(F.first("shingles").alias("s")), few)
    both = pairs.join(found.select(F.col("key").alias("u"), F.col("s").alias("a")), "u").join(found.select(F.col("key").alias("v"), F.col("s").alias("b")), "v")

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        sides = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        found = [similarity(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in sides]
        yield {"u": batch.column(0), "v": batch.column(1), "near": [s > least if strict else s >= least for s in found]}

    return mapped(both, ["u", "v", "a", "b"], "u long, v long, near boolean", each, rows=128)


def _crowded(waiting: DataFrame) -> DataFrame:
    """Rows (key, band, ...) of bands that hold more than one node."""
    return cut(waiting.join(waiting.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "band").select(waiting.columns))


def _chosen(waiting: DataFrame, most: int) -> DataFrame:
    """(band, p, b): each band's least node and, by a hash, about `most` - 1 others, with their signs."""
    size = waiting.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / most)).cast("long")
    others = (F.pmod(F.xxhash64("key", "band"), step) == 0) if most > 1 else F.lit(False)
    return waiting.join(size, "band").where((F.col("key") == F.col("first")) | others).select("band", F.col("key").alias("p"), F.col("signs").alias("b"))


def near_copies(docs: DataFrame, words: int = WORDS, least: float = 0.8, strict: bool = False) -> DataFrame:
    """(doc_id, text_hash, component_id, root) for each row (doc_id, text): the smallest doc_id reachable over links of similarity
    `least` or more (more than `least` if strict), the XXH64 of the row's text, and a number of its component that no other has,
    even if rows share a doc_id.

    Equal shingle sets are one node. In each band's bucket all nodes are compared with the least one; those that are not near it
    stay in the bucket and are compared with some of themselves, twice as many each round, until none is left, so that
    a large group of near copies costs its size and not its square, and one of unlike texts few rounds. Two nodes are first compared by
    their signs (size, SimHash of the distinct shingles, ends of minima, odd sketch), which travel with them; only pairs that these
    don't tell apart are open, and their sets are joined and compared exactly. Sketches grow with the sets, so that few pairs are open that are
    not near, among unlike copies of one text, too. If many are, no round takes more than 128 nodes a bucket.
    Rounds, and links, that are few rows go through one task, and what a round leaves behind is deleted before the next. Whoever is near a
    chosen node leaves the bucket with it, and meets those that stay in the other buckets they share. A null text is empty, and empty texts are copies of each other; a row with a null id
    links others and is no component's id unless no row of it has one. Repeated rows stay; an empty table gives no rows.
    """

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        sets = [shingles(t, words) for t in utf8(batch.column(1))]
        key = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
        least_ = [minima(s) if len(s) else None for s in sets]
        both = {"bands": [bands(s, m) if len(s) else [] for s, m in zip(sets, least_)], "signs": [signs(s, m) + odd(s) if len(s) else [] for s, m in zip(sets, least_)]}
        yield {"doc_id": batch.column(0), "text_hash": batch.column(2), "key": key, **both, "shingles": [s.tobytes() for s in sets]}

    named = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    own = kept(mapped(named, ["doc_id", "text", "text_hash"], "doc_id long, text_hash long, key long, bands array<long>, signs array<long>, shingles binary", each, rows=128))
    points = cut(own.groupBy("key").agg(F.min("doc_id").alias("least")))
    waiting = _crowded(own.select("key", F.explode("bands").alias("band")).distinct())
    signed = _asked(own.select("key", "signs"), waiting.select("key")).dropDuplicates(["key"])  # of the few that share a bucket
    waiting = cut(waiting.join(signed, "key"))
    links: list[DataFrame] = []
    held = [F.count("*"), F.coalesce(F.sum(F.size("signs")), F.lit(0))]
    most, (n, longs) = 1, waiting.agg(*held).first()
    while n:
        few = n * ROW + longs * 8 <= FEW_ROWS
        waiting = _one(waiting, few)
        chosen = _one(cut(_chosen(waiting, most)), few)
        left = waiting.repartition(8) if few and n * most > FEW_PAIRS else waiting  # few rows, but more pairs than one task should compare
        open_ = left.withColumnRenamed("signs", "a").join(chosen, "band").where((F.col("key") != F.col("p")) & alike(least))
        open_ = _one(cut(open_.select("band", "p", "key", (F.col("a")[0] + F.col("b")[0]).alias("size"))), few)
        pairs = open_.select(F.least("p", "key").alias("u"), F.greatest("p", "key").alias("v"), "size").distinct()
        size = 8 * (pairs.agg(F.sum("size")).first()[0] or 0)
        tried = confirmed(pairs.select("u", "v"), own.select("key", "shingles"), least, strict, size <= FEW_SETS) if size else pairs.withColumn("near", F.lit(False))
        tried = _one(cut(tried.where("near").select("u", "v")), few)
        links.append(tried)
        if len(links) == 8:  # else the plan would grow with the rounds
            links = [cut(reduce(DataFrame.unionByName, links))]
        both = _one(tried.select(F.col("u").alias("p"), F.col("v").alias("key")).unionByName(tried.select(F.col("v").alias("p"), F.col("u").alias("key"))), few)
        done = _one(open_.join(both, ["p", "key"], "left_semi").select("band", "key").unionByName(chosen.select("band", F.col("p").alias("key"))), few).distinct()
        if most < CHOSEN or open_.count() < OPEN:
            most *= 2
        waiting = _crowded(waiting.join(done, ["band", "key"], "left_anti"))
        n, longs = waiting.agg(*held).first()
        swept(docs.sparkSession)
    if not links:
        return own.select("doc_id", "text_hash", "key").join(points, "key").select("doc_id", "text_hash", F.col("least").alias("component_id"), F.col("key").alias("root"))
    placed = points.join(components(reduce(DataFrame.unionByName, links), few=FEW_LINKS).withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.select("doc_id", "text_hash", "key").join(placed.select("key", "root").join(ids, "root"), "key").select("doc_id", "text_hash", "component_id", "root")


def best_of_clusters(docs: DataFrame, score: Column, least: float = 0.85) -> DataFrame:
    """E7 (from prose): (doc_id, cluster, kept): clusters of documents (doc_id unique, text) linked at more than `least`, of each of
    which the member with the greatest score is kept, the least doc_id among equals. E9 is the same over projects' joined files."""
    own = near_copies(docs, least=least, strict=True).select("doc_id", F.col("component_id").alias("cluster")).join(docs.select("doc_id", score.alias("_s")), "doc_id")
    best = own.groupBy("cluster").agg(F.max_by("doc_id", F.struct("_s", -F.col("doc_id"))).alias("best"))
    return own.join(best, "cluster").select("doc_id", "cluster", (F.col("doc_id") == F.col("best")).alias("kept"))


def projects(files: DataFrame, project: str, order: str, text: str) -> DataFrame:
    """E9 (from prose): (project, text): a project's files joined in order. A project must fit a row, as its text does."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t"))))
    return files.groupBy(F.col(project).alias("project")).agg(F.array_join(parts["t"], "\n").alias("text"))
