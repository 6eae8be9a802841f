"""Cosine neighbours of a stated set of vectors, and mean cosines without pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors in a block.
BLOCK = 4096


def unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    m = np.stack([np.asarray(x, float) for x in column.to_pylist()])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def nearest(queries: DataFrame, against: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, s): the greatest cosine of each query with another vector of `against` (not with that of its own id).

    Queries are a stated set, met by all vectors in blocks of some thousand each, by matrix products; no task holds more than a
    block of either. Null vectors don't count; without others a query has no row; equal ids are one query.
    """
    queries, against = (df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("i"), F.col(vector).alias("v")) for df in (queries, against))
    nq, na = (max(1, -(-df.count() // BLOCK)) for df in (queries, against))
    block = lambda n: F.pmod(F.xxhash64("i"), F.lit(n)).cast("int")
    queries = queries.select("i", "v", block(nq).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(na - 1))).alias("ab"))
    against = against.select(F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), block(na).alias("ab"), F.col("i"), F.col("v"))

    def best(q: pa.Table, a: pa.Table) -> pa.Table:
        ids = q.column("i").to_numpy()
        out = np.full(len(ids), -np.inf)
        if len(ids) and a.num_rows:
            own = unit(q.column("v"))
            for k in range(0, a.num_rows, BLOCK):
                other = a.slice(k, BLOCK)
                s = own @ unit(other.column("v")).T
                s[ids[:, None] == other.column("i").to_numpy()[None, :]] = -np.inf
                out = np.maximum(out, s.max(axis=1))
        return pa.table({"i": pa.array(ids, pa.int64()), "s": out})

    found = queries.groupBy("qb", "ab").cogroup(against.groupBy("qb", "ab")).applyInArrow(best, "i long, s double").groupBy("i").agg(F.max("s").alias("s"))
    return found.where("s > double('-infinity')").withColumnRenamed("i", id_col)


def mean_cosine(rows: DataFrame, held: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, n, mean_cosine) of each group's vectors with all held-out ones, as the product with their mean direction; null without any."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    units = lambda df: df.select("*", F.transform(F.col(vector), lambda x: x.cast("double") / norm(F.col(vector))).alias("_u"))
    each = units(held).select(F.posexplode("_u").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m"))
    mean = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("_m"))  # a row with as many numbers as a vector has
    dot = F.aggregate(F.zip_with("_u", "_m", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return units(rows).join(F.broadcast(mean), F.lit(True)).groupBy(by).agg(F.count("*").alias("n"), F.avg(dot).alias("mean_cosine"))
