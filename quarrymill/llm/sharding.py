"""Uniform shuffles into shards of exact size, by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.base import cut, seeded, table

#: Rows, and bytes of the average row times rows, of a virtual partition or of a shard's part at most, of which a task sorts a few at a time.
PART, BYTES = 20_000, 16 << 20
#: Virtual partitions whose rows of the matrix one task draws.
GROUP = 1024


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws from good + bad are good: inversion over the ratios of neighbouring probabilities around the mode,
    which holds for any size (NumPy's own stops at 10**9)."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    all_ = good + bad
    mode = min(max((n + 1) * (good + 1) // (all_ + 2), low), high)
    wide = int(12 * math.sqrt(max(1.0, n * (good / all_) * (bad / all_)))) + 40
    up, down = np.arange(mode, min(high, mode + wide), dtype=float), np.arange(mode, max(low, mode - wide), -1, dtype=float)
    more = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    less = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    weight = np.cumsum(np.concatenate([less[::-1], [1.0], more]))
    return mode - len(less) + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def shard_sizes(total: int, shards: int, rng: np.random.Generator) -> list[int]:
    """Rows of each shard, at most one apart; which ones get one more is drawn."""
    return [total // shards + int(k < total % shards) for k in rng.permutation(shards)]


def communication(rows: list[int], free: list[int], rng: np.random.Generator) -> np.ndarray:
    """Rows that each partition sends to each shard, drawn as a uniform shuffle of all rows would send them; shards end up with
    exactly `free` rows, which add up to those of the partitions."""
    free = list(free)
    matrix = np.zeros((len(rows), len(free)), np.int64)
    for p, n in enumerate(rows):
        left, room = n, sum(free)
        for k in range(len(free)):
            room -= free[k]
            matrix[p, k] = x = hypergeometric(rng, free[k], room, left)
            free[k] -= x
            left -= x
    return matrix


def bounds(count: DataFrame, shards: int, seed: int, group: int = GROUP) -> DataFrame:
    """(part, upto array<long>): how many of a partition's rows, in its own order, go to shards up to each but the last.

    count: (part, n). The matrix is drawn in two levels: what groups of partitions send, a row a group, on the driver; then each
    group's own rows in a task, as a uniform shuffle within what the group sends.
    """
    spark = count.sparkSession
    grouped = count.withColumn("g", F.floor(F.col("part") / group).cast("long"))
    totals = sorted((r.g, r.n) for r in grouped.groupBy("g").agg(F.sum("n").alias("n")).collect())
    rng = np.random.default_rng(seed)
    matrix = communication([n for _, n in totals], shard_sizes(sum(n for _, n in totals), shards, rng), rng)
    free = spark.createDataFrame([(g, [int(x) for x in row]) for (g, _), row in zip(totals, matrix)], "g long, free array<long>")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        own = communication(pdf["n"].tolist(), [int(x) for x in pdf["free"].iloc[0]], np.random.default_rng([seed, int(pdf["g"].iloc[0])]))
        return pd.DataFrame({"part": pdf["part"], "upto": np.cumsum(own, axis=1)[:, :-1].tolist()})

    return grouped.join(free, "g").groupBy("g").applyInPandas(run, "part long, upto array<long>")


def shuffled(df: DataFrame, shards: int, keys: tuple[str, ...] = ("doc_id", "text"), seed: int = 20, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """All rows and columns of df with a shard (0 to shards - 1; sizes at most one apart) and a slot (gapless from 0 in each shard).

    Rows fall into virtual partitions by a hash of the keys, each is permuted by a second hash, its runs go to the shards as
    the matrix says, and each shard is permuted by a third. Hashes of the rows' own values, not the place where a row was
    read, decide everything, so a task that runs again gives the same rows. No window holds a whole shard: slots are counted
    in parts of a shard by leading bits of the hash.

    Rows that are equal in all keys are interchangeable and stay as many. Null keys hash like other values. Columns of df
    with the names of the two new ones are replaced. An empty table gives no rows.
    """
    kept = [c for c in df.columns if c not in (shard_col, slot_col)]
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("r"), *[seeded(seed + i, *keys).alias(f"h{i}") for i in range(3)])
    texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    n, size = df.agg(F.count("*"), F.sum(sum(texts, F.lit(16)).cast("long"))).first()
    rows = max(1, min(PART, BYTES * n // max(1, size or 0)))
    parts, bits = max(1, math.ceil(n / rows)), max(0, math.ceil(math.log2(max(1, n / shards / rows))))
    keyed = keyed.withColumn("part", F.pmod("h0", F.lit(parts)))
    upto = cut(bounds(keyed.groupBy("part").agg(F.count("*").alias("n")), shards, seed))

    def sent(rows: DataFrame) -> DataFrame:
        ranked = rows.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy("h1", "h2"))).join(upto, "part")
        to = F.size(F.filter("upto", lambda x: x < F.col("i")))
        return ranked.withColumn("to", to).withColumn("sub", F.shiftrightunsigned("h2", 64 - bits) if bits else F.lit(0).cast("long"))

    sizes = sent(keyed.drop("r")).groupBy("to", "sub").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("to").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1))  # a row a part
    starts = sizes.select("to", "sub", F.coalesce(before, F.lit(0)).alias("start"))
    placed = sent(keyed).withColumn("j", F.row_number().over(Window.partitionBy("to", "sub").orderBy("h2", "h1", "h0"))).join(starts, ["to", "sub"])
    return placed.select("r.*", F.col("to").alias(shard_col), (F.col("start") + F.col("j") - 1).alias(slot_col))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law `rows`."""
    docs = shuffled(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
