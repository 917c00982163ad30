"""Value learning: fitted-Q iteration and linear conservative Q / quantile heads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.constants import STATE_COLUMNS
from policylake.learn.supervised import assemble, forest
from policylake.sources.sinks import staged


def fitted_q(train: DataFrame, support: DataFrame, actions: list[str], gamma: float = 0.97, iterations: int = 4):
    """Fitted-Q iteration; unsupported actions never enter the maximum, terminal rows do not bootstrap.

    Every round's targets are written to the shared folder, so the plan does not grow.
    """
    keep = ["row_id", "slice_type", "action", "utility", "done", *STATE_COLUMNS, *[f"next_{c}" for c in STATE_COLUMNS]]
    base = staged(train.select(*keep), "fqi-base")
    x = staged(assemble(base, actions).select("row_id", "utility", "done", "x"), "fqi-x")
    options = base.select("row_id", "slice_type", *[F.col(f"next_{c}").alias(c) for c in STATE_COLUMNS]).join(support, "slice_type")
    nxt = staged(assemble(options, actions).select("row_id", "x"), "fqi-next")
    targets = x.select("row_id", "x", F.col("utility").alias("target"))
    model = None
    for k in range(iterations):
        model = forest("target", 200 + k).fit(targets)
        if k + 1 == iterations:
            break
        best = model.transform(nxt).groupBy("row_id").agg(F.max("p_target").alias("m"))
        value = F.col("utility") + gamma * F.coalesce("m", F.lit(0.0)) * F.when(F.col("done"), 0.0).otherwise(1.0)
        targets = staged(x.join(best, "row_id", "left").select("row_id", "x", value.alias("target")), "fqi-targets")
    return model


def linear_q(
    train: DataFrame, features: list[str], next_features: list[str], actions: list[str], allowed: dict[str, list[str]],
    *, alpha: float, gamma: float = 0.97, epochs: int = 6, rate: float = 0.05, l2: float = 1e-5,
    quantiles: list[float] | None = None,
) -> np.ndarray:
    """Weights [head, action, feature]. Gradients are partial sums per partition, added in Spark.

    One head: squared TD error plus alpha * (masked log-sum-exp - Q of the logged action).
    Several heads: quantile-Huber loss of the same targets.
    """
    d, a, taus = len(features) + 1, len(actions), quantiles or [0.5]
    idx = {n: i for i, n in enumerate(actions)}
    mask = {s: np.isin(np.arange(a), [idx[x] for x in xs if x in idx]) for s, xs in allowed.items()}
    table = staged(train.select("slice_type", "action", "utility", "done", *features, *next_features), "linear-q")
    stats = table.select(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    mu = np.array([stats[f"m_{c}"] for c in features])
    sd = np.array([max(stats[f"s_{c}"] or 0.0, 1e-6) for c in features])
    w = np.zeros((len(taus), a, d))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for epoch in range(epochs):
        current = w.copy()

        def gradients(batches: Iterator[pd.DataFrame], weights=current) -> Iterator[pd.DataFrame]:
            total, n = np.zeros_like(weights), 0
            for pdf in batches:
                x = np.hstack([np.clip((pdf[features].to_numpy(float) - mu) / sd, -8, 8), np.ones((len(pdf), 1))])
                y = np.hstack([np.clip((pdf[next_features].to_numpy(float) - mu) / sd, -8, 8), np.ones((len(pdf), 1))])
                ok = np.vstack([mask[s] for s in pdf["slice_type"]])
                act = pdf["action"].map(idx).to_numpy()
                q = np.einsum("nd,had->nha", x, weights)
                nq = np.where(ok, np.einsum("nd,had->nha", y, weights).mean(axis=1), -np.inf).max(axis=1)
                target = pdf["utility"].to_numpy() + gamma * np.where(pdf["done"], 0.0, np.where(np.isfinite(nq), nq, 0.0))
                rows = np.arange(len(pdf))
                for h, tau in enumerate(taus):
                    err = q[rows, h, act] - target
                    slope = np.clip(err, -1, 1) * np.where(err > 0, 1 - tau, tau) * 2 if quantiles else err
                    g = np.zeros((len(pdf), a))
                    g[rows, act] = slope
                    if alpha and not quantiles:
                        z = np.where(ok, q[:, h], -np.inf)
                        e = np.exp(z - z.max(axis=1, keepdims=True))
                        soft = e / e.sum(axis=1, keepdims=True)
                        soft[rows, act] -= 1.0
                        g += alpha * soft
                    total[h] += g.T @ x
                n += len(pdf)
            yield pd.DataFrame({"pos": np.arange(total.size + 1), "g": np.append(total.ravel(), float(n))})

        sums = table.mapInPandas(gradients, "pos int, g double").groupBy("pos").agg(F.sum("g").alias("g"))
        flat = np.zeros(w.size + 1)
        for r in sums.collect():  # one number per weight
            flat[r["pos"]] = r["g"]
        grad = flat[:-1].reshape(w.shape) / max(flat[-1], 1.0) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.999 ** (epoch + 1))) + 1e-8)
    return np.concatenate([w[..., :-1] / sd, (w[..., -1:] - (w[..., :-1] * mu / sd).sum(axis=-1, keepdims=True))], axis=-1)


def greedy_action(rows: DataFrame, weights: np.ndarray, features: list[str], actions: list[str], allowed: dict[str, list[str]], tail: int | None = None) -> DataFrame:
    """Best supported action by the mean of the heads, or of the lowest `tail` heads."""
    w = weights[:tail].mean(axis=0) if tail else weights.mean(axis=0)

    def q(i: int):
        return sum((F.col(f) * float(w[i, j]) for j, f in enumerate(features)), start=F.lit(float(w[i, -1])))

    per = F.array(*[F.struct(F.round(q(i), 12).alias("s"), F.lit(-i).alias("ni"), F.lit(a).alias("action")) for i, a in enumerate(actions)])
    pool = None
    for s, xs in allowed.items():
        hit = _only(per, xs)
        pool = F.when(F.col("slice_type") == s, hit) if pool is None else pool.when(F.col("slice_type") == s, hit)
    return rows.withColumn("__b", F.array_max(pool)).withColumns({"greedy_action": F.col("__b.action"), "greedy_q": F.col("__b.s")}).drop("__b")


def _only(per, names: list[str]):
    return F.filter(per, lambda c: c["action"].isin(names))
