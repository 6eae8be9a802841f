"""Similarity and resampling that need Python, in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0.0 if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)])


def output_similarity(a: Column | str, b: Column | str) -> Column:
    """The ratio of matching blocks of two outputs; two empty ones are alike, a null is like nothing."""
    return F.pandas_udf(_ratios, DoubleType())(a, b)


def bootstrap(differences: list[float], rounds: int = 2000, seed: int = 42) -> tuple[float, float, float]:
    """S13 (from prose): mean of paired differences and its 95% interval by resampling; for at most some thousand pairs."""
    x = np.asarray(differences, float)
    rng = np.random.default_rng(seed)
    means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(rounds)])
    return float(x.mean()), float(np.quantile(means, 0.025)), float(np.quantile(means, 0.975))


def paired_t(difference: str) -> Column:
    """t of paired differences, as an aggregate; null for fewer than two or no spread."""
    spread = F.stddev_samp(difference)
    return F.when(spread > 0, F.avg(difference) / (spread / F.sqrt(F.count(difference))))
