"""Fitted tables shared by several queries: targets, tabular critic, candidate arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylake.config import CalibrationConfig, ObjectiveSettings
from policylake.constants import CONTEXT_COLUMNS
from policylake.functions.core import cond_rate
from policylake.operators import candidates, outcomes
from policylake.operators.order_stats import exact_quantiles
from policylake.sources import adapters


def targets(
    spark: SparkSession, sf: str, multi_ue: bool = False, cfg: ObjectiveSettings | None = None
) -> tuple[DataFrame, tuple[float, float]]:
    """Transitions with outcome costs; the energy scale is fitted on the training split."""
    t = adapters.prepared(spark, sf, multi_ue)
    scale = outcomes.fit_energy_scale(t.filter("publication_split = 'train'"))
    return outcomes.derive_targets(t, scale, cfg), scale


def policy_rows(t: DataFrame) -> DataFrame:
    return t.filter("publication_split = 'train' AND experiment = 'exp1'")


def evaluator_rows(t: DataFrame) -> DataFrame:
    return t.filter("publication_split = 'train' AND experiment = 'exp2'")


ROW_COLUMNS = [
    "row_id", "episode_id", "timestamp_s", "scenario", "training_config", "experiment", "base_station",
    "imsi_file", "slice_type", "action", "current_action", "publication_split", "sla_cost", "energy_cost",
    "stability_cost", "utility", *CONTEXT_COLUMNS,
]
POLICY_FIELDS = ["sla", "energy", "stability", "unc", "q"]
EVALUATOR_FIELDS = ["e_sla", "e_energy", "e_stability"]


_MODELS: dict[tuple, tuple] = {}


def fitted(spark: SparkSession, sf: str, multi_ue: bool = False) -> tuple:
    """(targets, outcome model, cells), fitted once per application and prepared table."""
    t, _ = targets(spark, sf, multi_ue)
    key = (spark.sparkContext.applicationId, tuple(sorted(adapters.prepared(spark, sf, multi_ue).inputFiles())))
    if key not in _MODELS:
        _MODELS[key] = candidates.fit_model(policy_rows(t), evaluator_rows(t))
    return t, *_MODELS[key]


def candidate_rows(
    spark: SparkSession, sf: str, fields: list[str] | None = None, multi_ue: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Rows with candidate arrays, and the fitted cells."""
    t, model, cells = fitted(spark, sf, multi_ue)
    return candidates.with_candidates(t.select(*ROW_COLUMNS), model, fields or POLICY_FIELDS), cells


def calibration_inputs(spark: SparkSession, sf: str):
    """Validation rows with candidates, frozen thresholds and the observed violation rate."""
    cfg, science = ObjectiveSettings(), CalibrationConfig()
    rows, _ = candidate_rows(spark, sf, POLICY_FIELDS + EVALUATOR_FIELDS)
    v = rows.filter("publication_split = 'validation'")
    limit = exact_quantiles(v.select("ood"), "ood", [1.0 - science.ood_fpr])[0]
    observed = v.agg(cond_rate(F.col("sla_cost") > science.reference_sla_threshold)).first()[0]
    return v, cfg, science, min(max(limit, 0.0), 1.0), observed
