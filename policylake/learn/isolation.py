"""Isolation forest: one small sample per tree, grown in parallel, scored batch-wise."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.functions.core import uniform
from policylake.operators.order_stats import exact_quantiles

SAMPLE = 256


def _c(n: float) -> float:
    return 0.0 if n <= 1 else 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int):
    if depth >= limit or len(x) <= 1 or np.all(x.max(axis=0) == x.min(axis=0)):
        return len(x)
    span = np.flatnonzero(x.max(axis=0) > x.min(axis=0))
    f = int(rng.choice(span))
    t = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < t
    return [f, t, _grow(x[left], rng, depth + 1, limit), _grow(x[~left], rng, depth + 1, limit)]


def fit_forest(train: DataFrame, features: list[str], trees: int = 16) -> list:
    """Sample about 256 rows per tree by portable draws; each tree grows in its own group."""
    n = train.count()
    p = min(1.0, SAMPLE / max(n, 1))
    picks = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), uniform("tree", t, F.col("row_id")).alias("u"))),
        lambda s: s["u"] < p,
    )
    long = train.select("row_id", *features, F.inline(picks))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        root = _grow(pdf[features].to_numpy(float), np.random.default_rng(int(key[0])), 0, 8)
        return pd.DataFrame({"tree": [int(key[0])], "model": [json.dumps([root, len(pdf)])]})

    rows = long.groupBy("tree").applyInPandas(grow, "tree int, model string").collect()  # one text per tree
    return [json.loads(r["model"]) for r in sorted(rows, key=lambda r: r["tree"])]


def score(df: DataFrame, forest: list, features: list[str]) -> DataFrame:
    """Add `decision`: larger means more normal."""
    def paths(node, x: np.ndarray, depth: int) -> np.ndarray:
        if not isinstance(node, list):
            return np.full(len(x), depth + _c(node))
        left = x[:, node[0]] < node[1]
        out = np.empty(len(x))
        out[left] = paths(node[2], x[left], depth + 1)
        out[~left] = paths(node[3], x[~left], depth + 1)
        return out

    @F.pandas_udf("double")
    def decision(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        mean = np.mean([paths(root, x, 0) / max(_c(n), 1e-9) for root, n in forest], axis=0)
        return pd.Series(0.5 - np.power(2.0, -mean))

    return df.withColumn("decision", decision(*features))


def ood_probability(train_scored: DataFrame, scored: DataFrame) -> DataFrame:
    """sigmoid((q05 - decision) / (median - q05)) with quantiles of the training rows."""
    q05, mid = exact_quantiles(train_scored.select("decision"), "decision", [0.05, 0.5])
    z = (q05 - F.col("decision")) / max(mid - q05, 1e-6)
    return scored.withColumn("ood", 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))
