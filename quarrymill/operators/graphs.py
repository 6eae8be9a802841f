"""Small graphs as DataFrames: ranks of tests and solutions, and layers of dependencies."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.base import components as _joined, cut as _cut


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """S11 (from prose): (node, rank) over undirected links (a, b), a fixed number of rounds; each adds up messages before its shuffle."""
    both = _cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degree = both.groupBy("a").agg(F.count("*").alias("degree"))
    links = _cut(both.join(degree, "a"))
    rank = degree.select(F.col("a").alias("node"), F.lit(1.0).alias("rank"))
    for _ in range(rounds):
        sent = links.join(rank, F.col("a") == F.col("node")).groupBy("b").agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        rank = _cut(sent.select(F.col("b").alias("node"), (1 - damping + damping * F.col("got")).alias("rank")))
    return rank


def _in_one_task(links: DataFrame) -> DataFrame:
    """components() of links that fit a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            u, v = (np.concatenate(x) for x in zip(*got))
            nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = nodes[_joined(len(nodes), index[: len(u)], index[len(u) :])]
            yield from pa.table({"node": nodes, "root": root}).to_batches(1 << 16)

    return links.coalesce(1).mapInArrow(run, "node long, root long")


def components(links: DataFrame, rounds: int = 60, few: int = 0) -> DataFrame:
    """(node, root) for each node of `links` (u long, v long), root the least node reachable.

    Alternating large-star and small-star steps; each costs two aggregates and a join on the node, whose hot keys Spark's
    skew join splits. The number of rounds grows with the logarithm of the longest path; the driver sees a count and a hash a
    round. Self links and repeated links do no harm; no links give no rows. Up to `few` links are followed in one task.
    """

    def nearest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    links = _cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if few and links.count() <= few:
        return _cut(_in_one_task(links))
    before = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.join(nearest(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        links = _cut(small.where("u <> v").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """L8 (from prose): (node, layer): a node's layer is one more than its deepest dependency's (edges: node, needs). Nodes on a
    circle, or behind one, have layer -1. A dependency that is no node is ignored. As many rounds as there are layers."""
    todo = nodes.select("node").distinct()
    left = edges.join(todo.withColumnRenamed("node", "needs"), "needs", "left_semi").select("node", "needs").where("node is not null").distinct()
    todo, left, done, layer = _cut(todo), _cut(left), [], 0
    while True:
        free = _cut(todo.join(left.select("node"), "node", "left_anti"))
        if free.isEmpty():
            break
        done.append(free.withColumn("layer", F.lit(layer)))
        if len(done) == 16:  # else the plan would grow with the layers
            done = [_cut(reduce(DataFrame.unionByName, done))]
        todo = _cut(todo.join(free, "node", "left_anti"))
        left = _cut(left.join(free.withColumnRenamed("node", "needs"), "needs", "left_anti"))
        layer += 1
    return reduce(DataFrame.unionByName, [*done, todo.withColumn("layer", F.lit(-1))])
