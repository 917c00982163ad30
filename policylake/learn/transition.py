"""One-step transition regression: ridge on a quadratic basis, many targets, margins from held-out episodes.

Every task sums the products of its basis columns with each other and with all targets; the sums are
added in Spark and one system is solved for all targets at once. Residual margins come from calibration
episodes that the fit never saw.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.functions.core import uniform
from policylake.operators.quantiles import quantiles
from policylake.sources.sinks import staged

ALPHA = 0.65
CALIBRATION_SHARE = 0.20
UPPER = 0.90


def calibrates() -> Column:
    """Whether a row's episode is kept from the fit, by hash."""
    return uniform("transition", F.col("episode_id")) < CALIBRATION_SHARE


def pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


@dataclass(frozen=True)
class TransitionModel:
    features: list[str]
    targets: list[str]
    mean: np.ndarray
    spread: np.ndarray
    target_spread: np.ndarray
    weights: np.ndarray  # basis column by target, in units of the target's spread

    def predict(self) -> dict[str, Column]:
        """Predicted targets in units of their spread, as column expressions."""
        z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(self.features, self.mean, self.spread, strict=True)]
        basis = [F.lit(1.0), *z, *[z[i] * z[j] for i, j in pairs(len(z))]]
        return {t: sum((b * float(w) for b, w in zip(basis[1:], self.weights[1:, k], strict=True)), F.lit(float(self.weights[0, k]))) for k, t in enumerate(self.targets)}


def fit(rows: DataFrame, features: list[str], targets: list[str], alpha: float = ALPHA) -> TransitionModel:
    """Ridge of all targets on intercept, scaled features, their squares and products; the intercept is free."""
    table = staged(rows.select(*features, *targets).dropna(), "transition-fit")
    found = table.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in [*features, *targets]]).first()
    mean = np.array([found[f"m_{c}"] for c in features])
    spread = np.array([found[f"s_{c}"] or 1.0 for c in features])
    scale = np.array([found[f"s_{c}"] or 1.0 for c in targets])
    d = len(features)
    width = 1 + d + len(pairs(d))
    left, right = np.array(pairs(d)).T

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width + len(targets)))
        for pdf in batches:
            z = (pdf[features].to_numpy(float) - mean) / spread
            x = np.hstack([np.ones((len(z), 1)), z, z[:, left] * z[:, right]])
            total += x.T @ np.hstack([x, pdf[targets].to_numpy(float) / scale])
        yield pd.DataFrame({"pos": np.arange(total.size), "s": total.ravel()})

    sums = np.zeros(width * (width + len(targets)))
    for r in table.mapInPandas(summed, "pos int, s double").groupBy("pos").agg(F.sum("s").alias("s")).collect():  # one number per product
        sums[r["pos"]] = r["s"]
    sums = sums.reshape(width, -1)
    penalty = np.diag([0.0, *[alpha] * (width - 1)])
    return TransitionModel(features, targets, mean, spread, scale, np.linalg.solve(sums[:, :width] + penalty, sums[:, width:]))


def residuals(rows: DataFrame, model: TransitionModel, keep: list[str]) -> DataFrame:
    """Long form: `target`, `residual` (observed minus predicted, in units of the target's spread)."""
    predicted = model.predict()
    each = [F.struct(F.lit(t).alias("target"), (F.col(t) / float(s) - predicted[t]).alias("residual")) for t, s in zip(model.targets, model.target_spread, strict=True)]
    return rows.select(*keep, F.inline(F.array(*each)))


def margins(calibration: DataFrame) -> DataFrame:
    """Per target: 90 % quantile of the residual and the mean of what reaches it, neither below zero."""
    q = quantiles(calibration, ["target"], {"residual": [UPPER]}).select("target", F.greatest(F.lit(0.0), F.col("residual_0")).alias("upper"), F.col("residual_0").alias("__q"))
    tail = calibration.join(q, "target").where(F.col("residual") >= F.col("__q")).groupBy("target").agg(F.avg("residual").alias("__t"))
    return q.join(tail, "target").select("target", "upper", F.greatest("upper", "__t").alias("tail"))
