"""Statistics over counts as Column builders: nothing here needs Python on the executors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.base import cut


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a proportion; nulls for n = 0."""
    n = F.when(n > 0, n.cast("double"))
    p = k.cast("double") / n
    middle = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, relative error about 1e-7 (Chebyshev fit; Numerical Recipes, section 6.2)."""
    t = 1 / (1 + 0.5 * x)
    # fixed values: the fit's coefficients
    parts = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(parts[-1])
    for c in reversed(parts[:-1]):
        poly = c + t * poly
    return t * F.exp(-x * x + poly)


def two_proportions(k1: Column, n1: Column, k2: Column, n2: Column) -> tuple[Column, Column]:
    """S3: pooled z of two proportions and its two-sided p; no spread: 0 and 1."""
    pool = (k1 + k2) / (n1 + n2)
    spread = F.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))
    z = F.when(spread > 0, (k1 / n1 - k2 / n2) / spread).otherwise(0.0)
    return z, erfc(F.abs(z) / (2**0.5))


def log_factorial(m: Column) -> Column:
    """ln m!, by Stirling's series; by adding up below 20."""
    x = m.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    few = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(m.cast("int"), F.lit(1)), F.lit(20))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    return F.when(m < 20, few).otherwise(series)


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar, 1 if nothing is discordant. The binomial tail is summed from its largest term down, each
    term by its ratio to the next, until terms no longer count: their number grows with the root of the discordant pairs."""
    n, low = (b + c).cast("bigint"), F.least(b, c).cast("bigint")
    first = log_factorial(n) - log_factorial(low) - log_factorial(n - low) - n * math.log(2.0)
    terms = F.least(low, (20 * F.sqrt(n.cast("double")) + 50).cast("bigint"))
    tail = F.aggregate(
        F.when(terms > 0, F.sequence(F.lit(0).cast("bigint"), F.greatest(terms - 1, F.lit(0)))).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda a, k: F.struct((a["term"] * (low - k) / (n - low + k + 1)).alias("term"), (a["total"] + a["term"] * (low - k) / (n - low + k + 1)).alias("total")),
        lambda a: a["total"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(first) * tail))


def medians(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median): the exact middle value, or the mean of the two middle ones. Equal values are counted before the shuffle and
    dealt by ranges, so no group is ever in one task. Null values don't count."""
    from quarrymill.operators.split import cumulated

    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranked = cut(cumulated(counted, ["_g", "_v"], "_c"))
    groups = ranked.groupBy("_g").agg(F.min("before").alias("_start"), F.sum("_c").alias("_n"))
    own = ranked.join(groups.withColumnRenamed("_g", "_h"), F.col("_g").eqNullSafe(F.col("_h"))).withColumn("_b", F.col("before") - F.col("_start"))
    holds = lambda k: (F.col("_b") <= k) & (k < F.col("_b") + F.col("_c"))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    middle = own.where(holds(low) | holds(high)).groupBy("_g").agg(F.avg("_v").alias("median"))
    return middle.withColumnRenamed("_g", by)


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n-c, k) / C(n, k) as a product; null if there are fewer than k samples."""
    steps = F.sequence((n - c + 1).cast("int"), F.greatest(n, n - c + 1).cast("int"))
    missed = F.aggregate(steps, F.lit(1.0), lambda a, i: a * (1 - F.lit(float(k)) / i))
    return F.when(n < k, None).when(n - c < k, 1.0).when(c == 0, 0.0).otherwise(1 - missed)


def advantage(reward: Column, *group: str) -> Column:
    """(reward - mean) / population deviation within a group; 0 where a group has no spread."""
    w = Window.partitionBy(*group)
    spread = F.stddev_pop(reward).over(w)
    return F.when(spread > 1e-12, (reward - F.avg(reward).over(w)) / spread).otherwise(0.0)


def composite_reward(compiles: Column, runs: Column, match: Column, idiom: Column) -> Column:
    """S10."""
    return 0.3 * compiles.cast("int") + 0.3 * runs.cast("int") + 0.3 * match.cast("int") + 0.1 * idiom.cast("double")


def tiered_reward(exact: Column, runs: Column, compiles: Column, out: Column, sim: Column) -> Column:
    """Tiers whose ceilings lie below the next floor, rounded half-even to 4 digits."""
    return F.bround(F.when(exact, 1.0).when(runs, F.least(F.lit(0.80), 0.40 + 0.25 * out + 0.15 * sim)).when(compiles, 0.20 + 0.15 * sim).otherwise(0.15 * sim), 4)


def perplexity(loss: Column) -> Column:
    """S12."""
    return F.exp(loss)


def verdict(wins: Column, losses: Column, need: int = 4) -> Column:
    """Holds, worse, or indistinguishable, of significant wins and losses among six comparisons."""
    return F.when((wins >= need) & (losses == 0), "holds").when((losses >= need) & (wins == 0), "worse").otherwise("indistinguishable")
