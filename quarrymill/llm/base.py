"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.base import arrow_schema, components, cut, forget, kept, mapped, released, remembered, small_batches, utf8

__all__ = ["arrow_schema", "components", "cut", "forget", "kept", "mapped", "released", "remembered", "seeded", "small_batches", "table", "utf8"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeded(seed: int, *columns: str) -> F.Column:
    """A hash that looks random: equal inputs and seeds give equal values wherever and however often a task runs."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])
