"""Curves and logs: parsing, forward fill, run segments, gates over snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The measures a training log's lines may hold, and how they are written. `nan` matches none of them.
MEASURES = {
    "iteration": r"\bIter (\d+):", "train_loss": r"Train loss ([-\d.]+)", "val_loss": r"Val loss ([-\d.]+)", "learning_rate": r"Learning Rate ([-\d.eE+]+)",
    "it_per_sec": r"It/sec ([-\d.]+)", "tokens_per_sec": r"Tokens/sec ([-\d.]+)", "trained_tokens": r"Trained Tokens (\d+)", "peak_mem": r"Peak mem ([-\d.]+)",
}


def parsed_log(lines: DataFrame) -> DataFrame:
    """Lines (file, ord, line) with each measure (-1: missing), the banner's offset, and whether a loss is NaN."""
    text = F.regexp_replace("line", r"\x1b\[[0-9;]*m", "")
    found = {k: F.coalesce(F.regexp_extract(text, p, 1).try_cast("double"), F.lit(-1.0)) for k, p in MEASURES.items()}
    offset = F.regexp_extract(text, r"^>>> .*\((\d+)/\d+ done", 1).try_cast("bigint")
    return lines.select("file", "ord", *[v.alias(k) for k, v in found.items()], offset.alias("offset"), text.rlike(r"(?i)loss nan").alias("nan_loss"))


def true_steps(log: DataFrame) -> DataFrame:
    """The last line of each step, where step = what the latest banner above says was done + the local iteration.
    Windows stay within a file."""
    w = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    steps = log.withColumn("step", F.coalesce(F.last("offset", ignorenulls=True).over(w), F.lit(0)) + F.col("iteration").cast("bigint")).where("iteration >= 0")
    return last_write(steps, ["file", "step"], "ord")


def last_write(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """E5/M6: of rows with equal keys the one written last; folded before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")


def filled(df: DataFrame, value: Column, by: list[str], order: str, name: str) -> DataFrame:
    """The latest non-null value so far, within each key."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def runs(df: DataFrame, ends: Column, by: list[str], order: str) -> DataFrame:
    """run_id counts the terminator rows above each row: a run ends with its terminator."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("run_id", F.coalesce(F.sum(ends.cast("long")).over(w), F.lit(0)))


def streak_gate(df: DataFrame, value: str, by: list[str], order: str, floor: float, share: float) -> DataFrame:
    """`fires` where this snapshot and the one before lie below max(floor, share x the first snapshot)."""
    w = Window.partitionBy(*by).orderBy(order)
    limit = F.greatest(F.lit(floor), share * F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low = df.withColumn("below", F.col(value) < limit)
    return low.withColumn("fires", F.col("below") & F.coalesce(F.lag("below").over(w), F.lit(False)))


def running_best(df: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """The best value so far over all of a key's history, and the step that reached it first."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", F.max(value).over(w)).withColumn("best_at", F.max_by(order, F.struct(F.col(value), -F.unix_micros(order) if dict(df.dtypes)[order] == "timestamp" else -F.col(order))).over(w))
