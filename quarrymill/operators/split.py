"""Samples and splits that depend on rows' own values, never on partitions or a sequential generator."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.base import cut


def draw(key: Column, salt: str) -> Column:
    """H8: a number in [0, 1) that looks random and depends on the key and a salt only; the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), key.cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def exact_split(df: DataFrame, key: str, fraction: float, salt: str = "42", parts: int = 64) -> DataFrame:
    """H4: column `split` with exactly clamp(half-even round(n x fraction), 1, n - 1) rows `train`, the others `valid`.

    A row is `train` if its draw ranks low enough: parts of the range of draws are counted, all rows below the part where the
    limit falls are taken, and only that part is ranked. Ties fall by key.
    """
    n = df.count()
    take = n if n < 2 else min(max(round(n * fraction), 1), n - 1)
    drawn = df.withColumn("_d", draw(F.col(key), salt)).withColumn("_p", F.floor(F.col("_d") * parts).cast("int"))
    count = dict(drawn.groupBy("_p").count().collect())
    below, edge = 0, 0
    for edge in range(parts):
        if below + count.get(edge, 0) >= take:
            break
        below += count.get(edge, 0)
    ranked = drawn.where(F.col("_p") == edge).withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("_d", key)))
    rest = drawn.where(F.col("_p") != edge).withColumn("_i", F.lit(0))
    return ranked.unionByName(rest).withColumn("split", F.when((F.col("_p") < edge) | ((F.col("_p") == edge) & (F.col("_i") <= take - below)), "train").otherwise("valid")).drop("_d", "_p", "_i")


def cumulated(df: DataFrame, order: list[str], weight: str | None = None) -> DataFrame:
    """df with `before`: the sum of a weight (a long; null: one a row) over all rows that come earlier in the whole table's order.

    Rows are dealt by ranges of the order, summed up within each range, and the ranges' sums, one number a range, are added up;
    no task holds more than a range. Rows equal in all of `order` stay in one range, so it should tell rows apart.
    """
    value = F.col(weight) if weight else F.lit(1).cast("long")
    ranged = cut(df.withColumn("_w", value).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    total = ranged.groupBy("_p").agg(F.sum("_w").alias("_t"))
    upto = F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    start = F.broadcast(total.select("_p", F.coalesce(upto, F.lit(0)).alias("_s")))
    own = F.sum("_w").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("_o", F.coalesce(own, F.lit(0))).join(start, "_p").withColumn("before", F.col("_s") + F.col("_o")).drop("_w", "_p", "_s", "_o")


def shuffled(df: DataFrame, key: str, salt: str = "42") -> DataFrame:
    """H7: all rows with a position from 0 in a seeded order of the whole table, which depends on keys and salt only."""
    return cumulated(df.withColumn("_d", draw(F.col(key), salt)), ["_d", key]).withColumnRenamed("before", "position").drop("_d")


def manual_sample(df: DataFrame, key: str, run: Column, low: float = 0.05, high: float = 0.10) -> DataFrame:
    """H11 (from prose): rows to look at by hand: of each run a share between `low` and `high` that the run draws, other rows each run."""
    share = low + (high - low) * draw(run, "share")
    return df.where(draw(F.concat_ws("/", run.cast("string"), F.col(key).cast("string")), "manual") < share)


def disjoint_union(parts: list[DataFrame], whole: DataFrame, key: str) -> DataFrame:
    """H5: (key, parts, in_whole) of keys that aren't in exactly one part and in the whole; must be empty."""
    rows = [p.select(F.col(key), F.lit(1).alias("_n"), F.lit(0).alias("_w")) for p in parts] + [whole.select(F.col(key), F.lit(0).alias("_n"), F.lit(1).alias("_w"))]
    both = reduce(DataFrame.unionByName, rows)
    return both.groupBy(key).agg(F.sum("_n").alias("parts"), F.sum("_w").alias("in_whole")).where("parts <> 1 or in_whole <> 1")


def stratified(df: DataFrame, key: str, strata: list[str], shares: tuple[tuple[str, float], ...] = (("train", 0.9), ("valid", 0.05), ("test", 0.05)), salt: str = "42", rows: int = 100_000) -> DataFrame:
    """H9 (from prose): column `split` with each stratum shared out by rank of its rows' draws.

    Draws are counted in ranges, of about `rows` rows of the whole table, and only the ranges where a share ends are ranked, so
    no stratum is ever in one task. A share ends at the half-even rounding of the stratum's size times the shares so far, as a
    decimal, as SQL has it: in doubles, products just above a half fall on it. Null strata are strata; the key must be unique, but for
    nulls, which come last.
    """
    parts = max(16, -(-df.count() // rows))
    drawn = df.withColumn("_d", draw(F.col(key), salt)).withColumn("_p", F.coalesce(F.floor(F.col("_d") * parts).cast("int"), F.lit(parts)))
    names = [f"_s{i}" for i in range(len(strata))]
    count = drawn.groupBy(*[F.col(s).alias(n) for s, n in zip(strata, names)], F.col("_p").alias("_q")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*names)  # a row a range
    upto, limits = 0.0, []
    for _, share in shares[:-1]:
        upto += share
        limits.append(F.bround(F.col("_n").cast("decimal(19,0)") * F.lit(Decimal(repr(upto))), 0).cast("long"))
    count = count.withColumn("_n", F.sum("_c").over(w)).withColumn("_b", F.sum("_c").over(w.orderBy("_q")) - F.col("_c")).withColumn("_l", F.array(*limits))
    count = count.withColumn("_edge", F.exists("_l", lambda x: (x > F.col("_b")) & (x < F.col("_b") + F.col("_c")))).select(*names, "_q", "_b", "_l", "_edge")
    same = [F.col(s).eqNullSafe(F.col(n)) for s, n in zip(strata, names)]
    placed = cut(drawn.join(count, reduce(lambda a, b: a & b, same, F.col("_p") == F.col("_q"))))
    ranked = placed.where("_edge").withColumn("_i", F.row_number().over(Window.partitionBy(*names, "_q").orderBy(F.col("_d").asc_nulls_last(), key)))
    both = ranked.unionByName(placed.where("not _edge").withColumn("_i", F.lit(1)))
    behind = F.size(F.filter("_l", lambda x: x < F.col("_b") + F.col("_i")))  # shares that end before this row
    split = F.element_at(F.array(*[F.lit(name) for name, _ in shares]), behind + 1)
    return both.withColumn("split", split).select(*df.columns, "split")


def systematic(df: DataFrame, ordinal: str, every: int = 40, offsets: tuple[int, ...] = (0, 1)) -> DataFrame:
    """H3: rows whose ordinal leaves one of some remainders."""
    return df.where(F.pmod(F.col(ordinal), F.lit(every)).isin(*offsets))


def first_n(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    """The first n rows by ordinal; only n rows a task reach the last one."""
    return df.orderBy(ordinal).limit(n)


def sample_k(df: DataFrame, key: str, k: int, salt: str = "42") -> DataFrame:
    """H6: exactly k rows without replacement, by least draw."""
    return df.withColumn("_d", draw(F.col(key), salt)).orderBy("_d", key).limit(k).drop("_d")
