"""Spectra of matrices: Marchenko-Pastur signal to noise, stable rank, and ranking of layers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.base import cut
from quarrymill.operators.split import cumulated


def snr_of_values(values: np.ndarray, m: int, n: int, variance: float) -> tuple[float, int, float]:
    """(signal / noise, signals, edge) of eigenvalues s^2 / n above and below the Marchenko-Pastur edge, m <= n. No variance:
    zeros; no noise: infinity."""
    if variance <= 0:
        return 0.0, 0, 0.0
    edge = variance * (1 + (m / n) ** 0.5) ** 2
    noise, signal = float(values[values <= edge].sum()), float(values[values > edge].sum())
    return (signal / noise if noise else float("inf")), int((values > edge).sum()), edge


def snr(matrix: np.ndarray) -> tuple[float, int, float]:
    """S7 of a matrix at hand."""
    m, n = sorted(matrix.shape)
    return snr_of_values(np.linalg.svd(matrix, compute_uv=False) ** 2 / n, m, n, float(matrix.var()))


def stable_rank(values: np.ndarray) -> float:
    """(sum of s)^2 / sum of s^2."""
    total = float((values**2).sum())
    return float(values.sum()) ** 2 / total if total else 0.0


def low_rank_values(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Singular values of p @ q through the triangular factor of p: the dense product is never formed."""
    return np.linalg.svd(np.linalg.qr(p, mode="r") @ q, compute_uv=False)


def snr_by_group(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, snr, n_signal, edge): each group's vectors are a matrix, whose squared singular values are the eigenvalues of the sum
    of its vectors' outer products. Each task adds up those of its rows, so only a square matrix a task and group is
    shuffled, never the vectors. Null vectors don't count."""
    schema = "g string, n long, d int, total double, gram array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str | None, list] = {}
        for b in batches:
            names = np.array(b.column(0).to_pylist(), object)
            m = np.array(b.column(1).to_pylist(), float).reshape(len(names), -1)
            for g in dict.fromkeys(names.tolist()):
                own = m[names == g]
                old = grams.setdefault(g, [0, m.shape[1], 0.0, 0.0])
                grams[g] = [old[0] + len(own), m.shape[1], old[2] + own.sum(), old[3] + own.T @ own]
        rows_ = [(g, n, d, total, gram.ravel().tolist()) for g, (n, d, total, gram) in grams.items()]
        if rows_:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_), (pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.float64())))], ["g", "n", "d", "total", "gram"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        n, d = int(pdf["n"].sum()), int(pdf["d"].iloc[0])
        gram = sum(np.asarray(x, float) for x in pdf["gram"]).reshape(d, d)
        small, large = sorted((n, d))
        values = np.maximum(np.linalg.eigvalsh(gram), 0.0)[::-1][:small] / large
        variance = float(np.trace(gram)) / (n * d) - (float(pdf["total"].sum()) / (n * d)) ** 2
        value, count, edge = snr_of_values(values, small, large, variance)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "snr": [value], "n_signal": [count], "edge": [edge]})

    own = rows.select(F.col(group).cast("string").alias("g"), F.col(vector).alias("v")).where("v is not null")
    return own.mapInArrow(partial, schema).groupBy("g").applyInPandas(whole, "g string, snr double, n_signal long, edge double")


def layer_ranks(scores: DataFrame, layer: str, module: str, value: str, k: int) -> DataFrame:
    """Layers by the mean of their modules' z-scores, lower index first on ties, whether one ties with the next. Means and
    spreads are a row a module; ranks are counted in ranges, so any number of layers will do."""
    by = scores.groupBy(F.col(module).alias("_m")).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    z = F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mean")) / F.col("_sd")).otherwise(0.0)
    mean = scores.join(by, F.col(module).eqNullSafe(F.col("_m"))).withColumn("z", z).groupBy(layer).agg(F.avg("z").alias("score"), F.count("*").alias("modules"))
    ranked = cut(cumulated(mean.withColumn("_key", -F.bround("score", 9)), ["_key", layer]))
    last = ranked.groupBy("_key").agg(F.max("before").alias("_last"))
    out = ranked.join(last, "_key").withColumn("rank", (F.col("before") + 1).cast("int")).withColumn("tie_next", F.col("before") < F.col("_last"))
    return out.withColumn("chosen", F.col("rank") <= k).select(layer, "score", "modules", "rank", "tie_next", "chosen")


def compared(ranks: DataFrame, layer: str, baseline: DataFrame) -> DataFrame:
    """How many chosen layers a baseline (one column) has too, and whether all scores are alike, so that ranks mean nothing."""
    there = ranks.join(baseline.select(F.col(baseline.columns[0]).alias(layer)).distinct().withColumn("_b", F.lit(True)), layer, "left")
    return there.agg(F.count_if("chosen").alias("chosen"), F.count_if(F.col("chosen") & F.col("_b").isNotNull()).alias("overlap"), (F.max("score") - F.min("score") < 1e-9).alias("null_by_construction"))
