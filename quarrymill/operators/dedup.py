"""Deduplication: keep-first, by priority, greedy over two keys, by shingles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.base import cut as _cut


def keep_first(df: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """The first row of each key in the given order, folded before the shuffle, so a key with a third of all rows is a row a task."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order).alias("_first")).select("_first.*")


def greedy_two_keys(df: DataFrame, order: str, a: str, b: str) -> DataFrame:
    """Rows kept by going through all in order and dropping whoever shares either key with a row kept before.

    Not two stacked keep-firsts: a row dropped for one key must not block others by its second. Solved in parallel rounds: of
    the undecided rows, each that is first for both its keys among the undecided is kept (no earlier row can block it); those
    that share a key with a kept row are dropped. Each round decides at least one row of each group of rows linked by keys.
    Nulls are keys like others; `order` must be unique.
    """
    todo = df.select(F.col(order).alias("o"), F.coalesce(F.col(a).cast("string"), F.lit("\x00")).alias("a"), F.coalesce(F.col(b).cast("string"), F.lit("\x00")).alias("b"))
    kept: list[DataFrame] = []
    while True:
        first_a, first_b = (todo.groupBy(k).agg(F.min("o").alias(f"m{k}")) for k in ("a", "b"))
        now = _cut(todo.join(first_a, "a").join(first_b, "b").where("o = ma and o = mb").select("o", "a", "b"))
        kept.append(now.select("o"))
        if len(kept) == 16:  # else the plan would grow with the rounds
            kept = [_cut(reduce(DataFrame.unionByName, kept))]
        todo = _cut(todo.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti"))
        if todo.isEmpty():
            return df.join(reduce(DataFrame.unionByName, kept).withColumnRenamed("o", order), order, "left_semi")


def shingles(words: Column, k: int) -> Column:
    """Distinct k-word shingles of an array of words; fewer words give none."""
    n = F.size(words) - (k - 1)
    return F.array_distinct(F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, k), " "))).otherwise(F.array().cast("array<string>")))


def contamination(docs: DataFrame, held: DataFrame, k: int = 14, broadcast: int = 1_000_000) -> DataFrame:
    """E6 (from prose): (doc_id, shared, total) for documents that share k-word shingles with held-out texts.

    docs: (doc_id, words); held: (words). Held-out shingles come first and once each, so a shared passage never makes pairs; where
    they are few, by count, they are broadcast, so that documents' shingles are never shuffled; rows of documents are counted
    where they are, before any shuffle by document.
    """
    keys = _cut(held.select(F.explode(shingles(F.col("words"), k)).alias("s")).distinct())
    keys = F.broadcast(keys) if keys.count() <= broadcast else keys
    own = docs.select("doc_id", F.explode(shingles(F.col("words"), k)).alias("s"))
    total = docs.select("doc_id", F.size(shingles(F.col("words"), k)).alias("total"))
    hits = own.join(keys, "s", "left_semi").groupBy("doc_id").agg(F.count("*").cast("int").alias("shared"))
    return hits.join(total, "doc_id")
