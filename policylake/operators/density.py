"""Density models of a group's reference rows: shrunk Gaussian and two-part diagonal mixture.

Both are fitted by sums over rows: the Gaussian from means, products of centred features and the fourth
moment that its shrinkage towards a ball needs; the mixture by rounds of expectation and
maximisation, each one aggregate over all groups. Models are one row per group, so rows
meet them in one join, and scoring stays in column expressions (forward substitution through the
Cholesky factor; log densities).

Groups are few (roles, slices, actions); the driver holds the mixture's parameters of each, at most
`MOST_GROUPS` of them. Rows with a missing feature are no reference and get no score.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.functions.core import finite
from policylake.functions.dims import constant

MOST_GROUPS = 20_000
LEAST_PIVOT = 1e-12
LEAST_VARIANCE = 1e-3  # added to every variance of the mixture
TWO_PARTS_FROM = 32  # rows of a group


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def whole_rows(rows: DataFrame, features: list[str]) -> DataFrame:
    return rows.where(reduce(lambda a, b: a & b, [finite(f) for f in features]))


def gaussian(rows: DataFrame, keys: list[str], features: list[str], minimum: int = 8) -> DataFrame:
    """Per group: `gn`, means `m<i>` and the Cholesky factor `l<i>_<j>` of the shrunk covariance.

    The share of the ball (mean variance in every direction) is the one of least expected squared
    error, from the spread of the outer products.
    """
    d = len(features)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    means = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("gn"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)])
    means = means.where(F.col("gn") >= minimum)
    centred = rows.join(means, keys).select(*keys, "gn", *[F.col(f"m{i}") for i in range(d)], *[(F.col(f) - F.col(f"m{i}")).alias(f"c{i}") for i, f in enumerate(features)])
    length = _sum([F.col(f"c{i}") * F.col(f"c{i}") for i in range(d)])
    table = centred.groupBy(*keys, "gn", *[f"m{i}" for i in range(d)]).agg(
        *[F.avg(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}") for i, j in pairs], F.avg(length * length).alias("fourth")
    )
    square = _sum([F.col(f"s{i}_{j}") * F.col(f"s{i}_{j}") * (1.0 if i == j else 2.0) for i, j in pairs])
    table = table.withColumn("ball", _sum([F.col(f"s{i}_{i}") for i in range(d)]) / float(d)).withColumn("square", square)
    apart = (F.col("square") - d * F.col("ball") * F.col("ball")) / float(d)
    noise = F.least((F.col("fourth") - F.col("square")) / (d * F.col("gn")), apart)
    table = table.withColumn("share", F.when((noise <= 0) | (apart <= 0), 0.0).otherwise(noise / apart))
    for j in range(d):  # columns of the factor, left to right
        known = {}
        for i in range(j, d):
            value = F.col(f"s{i}_{j}") * (1 - F.col("share"))
            if i == j:
                value = value + F.col("share") * F.col("ball")
            for k in range(j):
                value = value - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            known[i] = value
        table = table.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(known[j], F.lit(LEAST_PIVOT))))
        table = table.withColumns({f"l{i}_{j}": known[i] / F.col(f"l{j}_{j}") for i in range(j + 1, d)})
    return table.select(*keys, "gn", "share", *[f"m{i}" for i in range(d)], *[f"l{i}_{j}" for i, j in pairs])


def mahalanobis(rows: DataFrame, model: DataFrame, keys: list[str], features: list[str], name: str) -> DataFrame:
    """Add the squared distance from the group's Gaussian; null without a model."""
    d = len(features)
    out = rows.join(model.drop("gn", "share"), keys, "left")
    for i, f in enumerate(features):
        value = F.col(f) - F.col(f"m{i}")
        for k in range(i):
            value = value - F.col(f"l{i}_{k}") * F.col(f"__y{k}")
        out = out.withColumn(f"__y{i}", value / F.col(f"l{i}_{i}"))
    total = _sum([F.col(f"__y{i}") * F.col(f"__y{i}") for i in range(d)])
    return out.withColumn(name, total).select(*rows.columns, name)


def _log_density(features: list[str], part: str) -> Column:
    terms = [F.ln(2 * math.pi * F.get(f"{part}v", F.lit(i))) + (F.col(f) - F.get(f"{part}m", F.lit(i))) ** 2 / F.get(f"{part}v", F.lit(i)) for i, f in enumerate(features)]
    return F.ln(F.col(f"{part}w")) - 0.5 * _sum(terms)


def _models(spark, keys: list[str], parts: dict[tuple, list]) -> DataFrame:
    rows = [(*k, *(x for p in ps for x in (float(p[0]), [float(y) for y in p[1]], [float(y) for y in p[2]]))) for k, ps in parts.items()]
    fields = [f"{k} string" for k in keys] + [f"{p}w double, {p}m array<double>, {p}v array<double>" for p in "ab"]
    return constant(spark, rows, ", ".join(fields))


def mixture(rows: DataFrame, keys: list[str], features: list[str], minimum: int = 8, rounds: int = 100, tolerance: float = 1e-3) -> DataFrame:
    """Per group: weight, means and variances of two parts (`a`, `b`); small groups have part `a` only.

    The parts start from the two sides of the mean along the group's widest feature, so a rerun
    gives the same model. Rounds end when no group's mean log density moves by `tolerance`.
    """
    d = len(features)
    spark = rows.sparkSession
    stats = [F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.var_pop(f).alias(f"v{i}") for i, f in enumerate(features)]]
    first = rows.groupBy(*keys).agg(*stats).where(F.col("n") >= minimum).limit(MOST_GROUPS + 1).collect()
    if len(first) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    done, start = {}, []
    for r in first:
        key = tuple(r[k] for k in keys)
        m, v = [r[f"m{i}"] for i in range(d)], [r[f"v{i}"] for i in range(d)]
        if r["n"] < TWO_PARTS_FROM or max(v) == 0:
            done[key] = [(1.0, m, np.array(v) + LEAST_VARIANCE), (0.0, m, np.array(v) + LEAST_VARIANCE)]
        else:
            widest = int(np.argmax(v))
            start.append((*key, widest, m[widest]))

    def maximised(share: Column, data: DataFrame, density: Column) -> dict[tuple, tuple]:
        """Both parts and the mean log density of every group, from one aggregate."""
        sums = [F.sum(s * w).alias(f"{p}{k}") for p, w in (("a", 1 - F.col("__r")), ("b", F.col("__r"))) for k, s in [("n", F.lit(1.0)), *[(f"m{i}", F.col(f)) for i, f in enumerate(features)], *[(f"v{i}", F.col(f) * F.col(f)) for i, f in enumerate(features)]]]
        out = {}
        for r in data.withColumn("__r", share).withColumn("__d", density).groupBy(*keys).agg(F.avg("__d").alias("fit"), *sums).collect():
            total, parts = r["an"] + r["bn"], []
            for p in "ab":
                n = max(r[f"{p}n"], 10 * np.finfo(float).eps)
                m = np.array([r[f"{p}m{i}"] / n for i in range(d)])
                parts.append((n / total, m, np.maximum(np.array([r[f"{p}v{i}"] / n for i in range(d)]) - m * m, 0.0) + LEAST_VARIANCE))
            out[tuple(r[k] for k in keys)] = (r["fit"], parts)
        return out

    if start:
        split = constant(spark, start, ", ".join(f"{k} string" for k in keys) + ", widest int, middle double")
        side = (F.get(F.array(*features), F.col("widest")) > F.col("middle")).cast("double")
        found = maximised(side, rows.join(split, keys), F.lit(0.0))
        fit = dict.fromkeys(found, -math.inf)
        for _ in range(rounds):
            data = rows.join(_models(spark, keys, {k: ps for k, (_, ps) in found.items()}), keys)
            a, b = _log_density(features, "a"), _log_density(features, "b")
            top = F.greatest(a, b)
            found = maximised(1.0 / (1.0 + F.exp(a - b)), data, top + F.ln(F.exp(a - top) + F.exp(b - top)))
            settled = all(abs(now - fit[k]) < tolerance for k, (now, _) in found.items())
            fit = {k: now for k, (now, _) in found.items()}
            if settled:
                break
        done |= {k: ps for k, (_, ps) in found.items()}
    return _models(spark, keys, done)


def surprise(rows: DataFrame, model: DataFrame, keys: list[str], features: list[str], name: str) -> DataFrame:
    """Add minus the log density under the group's mixture; null without a model or feature."""
    a, b = _log_density(features, "a"), F.when(F.col("bw") > 0, _log_density(features, "b")).otherwise(F.lit(-math.inf))
    both = rows.join(model, keys, "left").withColumns({"__a": a, "__b": b})
    top = F.greatest("__a", "__b")
    density = top + F.ln(F.exp(F.col("__a") - top) + F.exp(F.col("__b") - top))
    return both.withColumn(name, F.when(F.col("aw").isNotNull(), -density)).select(*rows.columns, name)
