"""Window operators over ordered episodes and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.operators.history import previous_value, previous_values, time_bucket
from policylake.operators.order_stats import positions


def discounted_return(
    df: DataFrame, gamma: float, horizon: int, bucket_seconds: float = 3600.0
) -> DataFrame:
    """Truncated discounted sum of the next `horizon` rewards, own reward first."""
    ahead = previous_values(
        df, ["episode_id"], ["timestamp_s"], time_bucket("timestamp_s", bucket_seconds),
        F.col("reward"), max(1, horizon), "__ahead", following=True, include_current=True,
    )
    terms = F.transform("__ahead", lambda r, i: r * F.pow(F.lit(gamma), i))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    return ahead.withColumn("discounted_return", total).drop("__ahead")


def replay_switches(
    df: DataFrame, action: str, bucket_seconds: float = 3600.0
) -> DataFrame:
    """Add `previous_action` of the same episode and whether the action changed."""
    out = previous_value(
        df, ["episode_id"], ["timestamp_s"], time_bucket("timestamp_s", bucket_seconds),
        F.col(action), "previous_action",
    )
    changed = F.coalesce(F.col(action) != F.col("previous_action"), F.lit(False))
    return out.withColumn("switch", changed)


def switch_rate(switch: str = "switch", previous: str = "previous_action") -> Column:
    """Switches divided by rows that have a predecessor."""
    pairs = F.count(previous)
    return F.count_if(switch) / F.greatest(pairs, F.lit(1))


def systematic_sample(
    df: DataFrame, groups: list[str], k: int, bucket_seconds: float = 3600.0
) -> DataFrame:
    """`k` evenly spaced rows per group in (episode, time) order; all rows of smaller groups."""
    placed = positions(
        df.withColumn("__tb", time_bucket("timestamp_s", bucket_seconds)),
        groups, ["episode_id", "__tb"], ["timestamp_s"], "__pos", "__size",
    )
    p, n = F.col("__pos"), F.col("__size")
    step = F.ceil(p * (k - 1) / (n - 1)).cast("long")
    hit = F.floor(step * (n - 1) / (k - 1)).cast("long") == p
    return placed.filter((n <= k) | hit).drop("__tb", "__pos", "__size")


def forecast_columns(history: Column, horizon: int, alpha: float = 0.45) -> dict[str, Column]:
    """EWMA, least-squares trend and ensemble forecasts from a history array (oldest first)."""
    n = F.size(history).cast("double")
    ewma = F.aggregate(
        F.slice(history, 2, F.greatest(F.size(history) - 1, F.lit(0))),
        history[0],
        lambda acc, x: alpha * x + (1 - alpha) * acc,
    )
    sx = n * (n - 1) / 2
    sxx = n * (n - 1) * (2 * n - 1) / 6
    sy = F.aggregate(history, F.lit(0.0), lambda acc, x: acc + x)
    sxy = F.aggregate(
        F.transform(history, lambda x, i: x * i), F.lit(0.0), lambda acc, x: acc + x
    )
    slope = (n * sxy - sx * sy) / F.nullif(n * sxx - sx * sx, F.lit(0.0))
    intercept = (sy - slope * sx) / n
    last = F.element_at(history, -1)
    steps = F.sequence(F.lit(0), F.lit(horizon - 1))
    trend = F.when(F.size(history) < 3, F.transform(steps, lambda _: last)).otherwise(
        F.transform(steps, lambda s: F.greatest(intercept + slope * (n + s), F.lit(0.0)))
    )
    flat = F.transform(steps, lambda _: ewma)
    return {"ewma": flat, "trend": trend, "persistence": F.transform(steps, lambda _: last)}
