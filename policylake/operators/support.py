"""Nearest-neighbour support of a proposed action in the training data of two roles.

All training rows of a (slice, action) group are its reference; radii come from all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.constants import CONTEXT_COLUMNS
from policylake.operators.neighbours import distinct_distances, point_counts
from policylake.operators.quantiles import quantiles
from policylake.sources.sinks import staged

KEYS = ["slice_type", "action"]
FEATURES = [f"z_{c}" for c in CONTEXT_COLUMNS]
LEAST_RADIUS = 1e-4


def fit_scaler(rows: DataFrame) -> dict[str, tuple[float, float]]:
    """Median and 10-90 % spread of each context feature."""
    q = quantiles(rows, [], {c: [0.10, 0.50, 0.90] for c in CONTEXT_COLUMNS}).first()
    spread = {c: q[f"{c}_2"] - q[f"{c}_0"] for c in CONTEXT_COLUMNS}
    return {c: (q[f"{c}_1"], spread[c] if spread[c] > 0 else 1.0) for c in CONTEXT_COLUMNS}


def scaled(scaler: dict[str, tuple[float, float]]) -> list[Column]:
    return [((F.col(c) - m) / s).alias(f"z_{c}") for c, (m, s) in scaler.items()]


def reference_points(rows: DataFrame, scaler: dict, minimum: int = 24, keys: list[str] = KEYS) -> DataFrame:
    """Distinct scaled points per group with their counts; groups of fewer than `minimum` rows are left out."""
    points = point_counts(rows.select(*keys, *scaled(scaler)), keys, FEATURES)
    enough = points.groupBy(*keys).agg(F.sum("n").alias("__n")).where(F.col("__n") >= minimum).select(*keys)
    return points.join(enough, keys, "left_semi")


def nearest_distance(rows: DataFrame, points: DataFrame, name: str) -> DataFrame:
    """(row_id, slice, action, distance) to the nearest reference point of the row's own group.

    `rows` holds scaled features under the reference's names.
    """
    d = distinct_distances(rows.withColumn("own", F.lit(False)), points, KEYS, FEATURES, name)
    return rows.select("row_id", *KEYS, *FEATURES).join(d.drop("own"), [*KEYS, *FEATURES], "left").select("row_id", *KEYS, name)


def support_radius(points: DataFrame, own: DataFrame, keys: list[str] = KEYS, quantile: float = 0.95) -> DataFrame:
    """Quantile of the distance of every reference row to the nearest other one, per group."""
    rows = points.join(own, [*keys, *FEATURES]).where("d IS NOT NULL")
    radius = quantiles(rows, keys, {"d": [quantile]}, weight="n")
    return radius.select(*keys, F.greatest(F.col("d_0"), F.lit(LEAST_RADIUS)).alias("radius"))


def role_support(rows: DataFrame, roles: dict[str, DataFrame], scaler: dict, minimum: int = 24) -> DataFrame:
    """Distance and support flag of every row's (slice, action) in each role.

    References and queries of all roles, and the reference rows' own distances, are one search.
    """
    keys = ["role", *KEYS]
    tagged = reduce(lambda a, b: a.unionByName(b), [df.select(*KEYS, *CONTEXT_COLUMNS).withColumn("role", F.lit(r)) for r, df in roles.items()])
    points = staged(reference_points(tagged, scaler, minimum, keys), "reference")
    query = rows.select("row_id", *KEYS, *scaled(scaler))
    asked = query.withColumn("role", F.explode(F.array(*map(F.lit, roles)))).withColumn("own", F.lit(False))
    every = asked.select(*keys, *FEATURES, "own").unionByName(points.select(*keys, *FEATURES).withColumn("own", F.lit(True)))
    d = staged(distinct_distances(every, points, keys, FEATURES, "d"), "distances")
    radius = support_radius(points, d.where("own").drop("own"), keys)
    judged = staged(d.where("NOT own").join(radius, keys, "left").select(*keys, *FEATURES, "d", F.coalesce(F.col("d") <= F.col("radius"), F.lit(False)).alias("ok")), "distances")
    out = query
    for role in roles:
        mine = judged.where(F.col("role") == role).select(*KEYS, *FEATURES, F.col("d").alias(f"{role}_distance"), F.col("ok").alias(f"{role}_ok"))
        out = out.join(mine, [*KEYS, *FEATURES], "left").withColumn(f"{role}_ok", F.coalesce(f"{role}_ok", F.lit(False)))
    return out.drop(*KEYS, *FEATURES)


def guard(rows: DataFrame) -> DataFrame:
    """Keep a supported proposal, else an eligible own action, else the slice fallback."""
    ok = F.col("policy_ok") & F.col("evaluator_ok")
    own = F.col("cur").isNotNull()
    return rows.withColumns(
        {
            "locally_supported": ok,
            "guarded_action": F.when(ok, F.col("action")).when(own, F.col("current_action")).otherwise(F.col("fallback")),
            "fallback_used": ~ok & ~own,
        }
    )
