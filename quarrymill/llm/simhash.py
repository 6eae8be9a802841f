"""SimHash near-duplicates: fingerprints, a vantage-point tree over them, and components of linked documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.base import arrow_schema, components, cut, mapped, table, utf8
from quarrymill.llm.graph import connected
from quarrymill.operators.near import majority

#: Fingerprints that are compared all with all at the bottom of a tree.
LEAF = 192


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of a text's word shingles: bit i is 1 if it is set in over half of the shingles' XXH64 (seed 42), repeats included.

    A-Z is lower-cased; a word is a run of other bytes than blanks and 9-13. Fewer words than a shingle has: the whole
    sequence is the only shingle. No words: 0.
    """
    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    line, length = b" ".join(w), np.fromiter(map(len, w), np.int64, len(w)) + 1
    end = np.cumsum(length)
    start, stop = (end - length)[:n].tolist(), (end[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(line[s:e], 42) for s, e in zip(start, stop)], np.uint64, n)
    return majority(h)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint's 64 bits as a signed long. A null text is empty."""

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"doc_id": batch.column(0), "fp": np.array([fingerprint(t, words) for t in utf8(batch.column(1))], np.uint64).view(np.int64)}

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], "doc_id long, fp long", each)


class Split:
    """A vantage point, the distance up to which others are inside, and the parts inside and outside (None: a leaf)."""

    def __init__(self, point: np.uint64, radius: int):
        self.point, self.radius, self.inside, self.outside, self.leaf = point, radius, None, None, -1


def best_split(sample: np.ndarray, reach: int) -> Split | None:
    """The vantage point and radius, of a few candidates, that leave the least work on either side, counting those inside
    but within reach of the boundary on both. None if no split spares work."""
    found, least = None, 0.9 * len(sample) ** 2
    for point in sample[:: max(1, len(sample) // 8)][:8]:
        count = np.cumsum(np.bincount(np.bitwise_count(sample ^ point), minlength=65))
        near = np.concatenate([np.zeros(reach, np.int64), count[:-reach]]) if reach else count
        work = count.astype(float) ** 2 + (len(sample) - near).astype(float) ** 2  # inside: distance <= r; outside, with guests: > r - reach
        r = int(work.argmin())
        if work[r] < least:
            found, least = Split(point, r), work[r]
    return found


def grow(sample: np.ndarray, reach: int, least: int) -> tuple[Split | None, int]:
    """A tree whose leaves hold about `least` of the sample, and the number of its leaves."""
    leaves = 0

    def build(part: np.ndarray) -> Split:
        nonlocal leaves
        split = best_split(part, reach) if len(part) > least else None
        if split is None:
            split = Split(np.uint64(0), 64)
            split.leaf, leaves = leaves, leaves + 1
            return split
        d = np.bitwise_count(part ^ split.point).astype(np.int64)
        split.inside, split.outside = build(part[d <= split.radius]), build(part[d > split.radius - reach])
        return split

    return build(sample), leaves


def route(tree: Split, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for each leaf that a point must be in: its own, and each where points outside a boundary may lie within reach."""
    rows, leaves, todo = [], [], [(tree, np.arange(len(points)))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if node.leaf >= 0:
            rows.append(own)
            leaves.append(np.full(len(own), node.leaf))
            continue
        d = np.bitwise_count(points[own] ^ node.point).astype(np.int64)
        todo += [(node.inside, own[d <= node.radius]), (node.outside, own[d > node.radius - reach])]
    return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def linked(points: np.ndarray, reach: int) -> np.ndarray:
    """Labels of the components of points linked at `reach` or fewer differing bits: a tree of vantage points down to small leaves,
    in which all pairs are compared. Two points in reach of each other meet in a leaf, as whoever is inside a boundary by
    `reach` or less also goes outside (triangle inequality)."""
    labels, todo = np.arange(len(points)), [np.arange(len(points))]
    while todo:
        own = todo.pop()
        split = best_split(points[own], reach) if len(own) > LEAF else None
        if split is not None:
            d = np.bitwise_count(points[own] ^ split.point).astype(np.int64)
            todo += [own[d <= split.radius], own[d > split.radius - reach]]
            continue
        for i in range(0, len(own), 512):
            a, b = np.nonzero(np.bitwise_count(points[own[i : i + 512], None] ^ points[None, own]) <= reach)
            a += i
            apart = a < b
            if apart.any():
                labels = _joined(labels, own[a[apart]], own[b[apart]])
    return labels


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of few links into labels that many nodes share: only the roots concerned are renumbered at once."""
    a, b = labels[a], labels[b]
    apart = a != b
    a, b = a[apart], b[apart]
    if not len(a):
        return labels
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    roots = components(len(nodes), index[: len(a)], index[len(a) :])
    to = np.arange(len(labels))
    to[nodes] = nodes[roots]
    return to[labels]


def links(points: DataFrame, reach: int = 3, shard: int = 65536, sample: int = 16384) -> DataFrame:
    """(u, v): links that connect all of `points` (fp long, distinct) that are `reach` or fewer bits apart, over whatever others.

    The top of the tree is grown on the driver from at most `sample` fingerprints (and 8 a shard); every fingerprint is then
    sent to its own shard and, where a boundary is near, to the shard beyond, and each shard is searched by a tree of its own.
    A shard gives a link for each point but the least of a component, so copies never make all pairs.
    """
    spark = points.sparkSession
    n = points.count()
    leaves = max(1, math.ceil(n / shard))
    some = np.array([r.fp for r in points.orderBy(F.xxhash64("fp")).limit(max(sample, 8 * leaves)).collect()], np.int64).view(np.uint64)
    tree, _ = grow(some, reach, max(LEAF // 8, len(some) // leaves))

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        own = batch.column(0).to_numpy()
        rows, leaf = route(tree, own.view(np.uint64), reach)
        yield {"shard": leaf, "fp": own[rows]}

    out = arrow_schema(spark, "u long, v long")

    def search(shard_of: pa.Table) -> pa.Table:
        own = np.sort(shard_of.column("fp").to_numpy())
        labels = linked(own.view(np.uint64), reach)
        other = np.nonzero(labels != np.arange(len(own)))[0]
        return pa.table([pa.array(own[other]), pa.array(own[labels[other]])], schema=out)

    return mapped(points, ["fp"], "shard long, fp long", each).groupBy("shard").applyInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, reach: int = 3, shard: int = 65536) -> DataFrame:
    """(doc_id, fp, component_id) for each row: component_id is the smallest doc_id reachable over links of `reach` or fewer bits.

    Nulls: a null text is empty, with fingerprint 0, linked like any other; a row with a null id keeps its fingerprint, links
    others, and is never a component's id unless no row of it has one (then null). Repeated rows stay repeated. An empty table
    gives no rows. Columns other than the two named are not read, so their names cannot clash.
    """
    own = cut(fingerprints(docs, id_col, text_col, words))
    points = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(links(points.select("fp"), reach, shard))
    placed = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(placed.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and component: see near_duplicates."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
