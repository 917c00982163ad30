"""Catalogues as tables: intents, policies, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylake.constants import INTENTS
from policylake.functions.dims import constant

WEIGHTS = ("w_latency", "w_loss", "w_throughput", "w_stability", "w_energy")


def intents(spark: SparkSession) -> DataFrame:
    """One row for each intent: weights, risk tolerance, energy budget and hard or soft constraints."""
    rows = [(name, *weights, risk, budget, [f"{m} {op} {v:g}{'' if hard else ' (soft)'}" for m, op, v, hard in constraints]) for name, (weights, risk, budget, constraints) in INTENTS.items()]
    return constant(spark, rows, "intent string, " + ", ".join(f"{w} double" for w in WEIGHTS) + ", risk_tolerance double, energy_budget double, constraints array<string>")


def enabled(catalogue: DataFrame) -> DataFrame:
    """Entries that are not switched off; a missing flag counts as on. An empty result stops the job."""
    kept = catalogue.where(F.coalesce(F.col("enabled"), F.lit(True))).drop("enabled")
    if not kept.limit(1).count():
        raise ValueError("the catalogue has no enabled entry")
    return kept


def required(catalogue: DataFrame, column: str, value: str) -> DataFrame:
    """The catalogue, if it has the row that everything falls back to."""
    if not catalogue.where(F.col(column) == value).limit(1).count():
        raise ValueError(f"the catalogue needs a row {value!r}")
    return catalogue


def policies(spark: SparkSession, path: str) -> DataFrame:
    """Policy catalogue of JSON lines with `policy`, checked for the fallback policy."""
    return required(spark.read.json(path), "policy", "balanced")


def sources(spark: SparkSession, path: str) -> DataFrame:
    """Source catalogue of JSON lines with `source_id` and an optional `enabled` flag."""
    raw = spark.read.json(path)
    return enabled(raw if "enabled" in raw.columns else raw.withColumn("enabled", F.lit(True)))
