"""Outcome costs of a transition: service, energy, stability, and the derived utility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.config import ObjectiveSettings
from policylake.functions.core import action_label, clip, decision_list, ratio
from policylake.operators.order_stats import exact_quantiles


def energy_raw(prefix: str = "next_") -> Column:
    """power * (0.30 + 0.45 load + 0.25 PRB pressure)."""
    power = F.greatest(F.col(f"{prefix}power_multiplier"), F.lit(0.0))
    granted = F.greatest(F.col(f"{prefix}granted_prbs"), F.lit(0.0))
    requested = F.greatest(F.col(f"{prefix}requested_prbs"), F.lit(1.0))
    load = clip(granted / requested, 0.0, 1.5)
    pressure = clip(granted / F.greatest(F.col(f"{prefix}slice_prb"), F.lit(1.0)), 0.0, 2.0)
    return power * (0.30 + 0.45 * load + 0.25 * F.least(pressure, F.lit(1.0)))


def fit_energy_scale(train: DataFrame) -> tuple[float, float]:
    """2 % and 98 % quantile of the raw energy proxy on the training rows."""
    q = exact_quantiles(train.select(energy_raw().alias("e")), "e", [0.02, 0.98])
    if q is None:
        raise ValueError("no training rows to scale the energy proxy")
    low, high = q
    return (low, low + 1.0) if high - low < 1e-9 else (low, high)


def sla_cost() -> Column:
    dl = F.greatest(F.col("next_dl_bitrate_mbps"), F.lit(0.0))
    grant = clip("next_grant_ratio", 0.0, 1.0)
    errors = clip(F.col("next_dl_errors_pct") / 100.0, 0.0, 1.0)
    queue = F.greatest(F.col("next_dl_buffer_bytes"), F.lit(0.0))
    pressure = queue / (queue + 1000.0)
    cost = decision_list(
        [
            (F.col("slice_type") == "eMBB", 0.75 * (1.0 - clip(dl / 1.0, 0.0, 1.0)) + 0.25 * errors),
            (
                F.col("slice_type") == "mMTC",
                0.70 * (1.0 - clip(dl / 0.03, 0.0, 1.0)) + 0.20 * (1.0 - grant) + 0.10 * errors,
            ),
            (
                F.col("slice_type") == "URLLC",
                0.65 * (1.0 - grant) + 0.20 * errors + 0.15 * pressure,
            ),
        ],
        0.0,
    )
    return clip(cost, 0.0, 1.0)


def current_action() -> Column:
    return action_label("scheduler_code", "slice_prb")


def stability_cost() -> Column:
    def moved(name: str, floor: float) -> Column:
        delta = F.abs(F.col(f"next_{name}") - F.col(name))
        return clip(ratio(delta, F.abs(F.col(name)) + floor), 0.0, 1.0)

    churn = F.when(current_action() != F.col("action"), 1.0).otherwise(0.0)
    grant = clip(F.abs(F.col("next_grant_ratio") - F.col("grant_ratio")), 0.0, 1.0)
    return clip(
        0.60 * churn + 0.20 * grant + 0.10 * moved("dl_bitrate_mbps", 0.10)
        + 0.10 * moved("dl_buffer_bytes", 100.0),
        0.0, 1.0,
    )


def utility_of(sla: Column, energy: Column, stability: Column, cfg: ObjectiveSettings) -> Column:
    cost = cfg.sla_weight * sla + cfg.energy_weight * energy + cfg.stability_weight * stability
    return 1.0 - cost / cfg.outcome_weight


def derive_targets(
    df: DataFrame, scale: tuple[float, float], cfg: ObjectiveSettings | None = None
) -> DataFrame:
    cfg = cfg or ObjectiveSettings()
    low, high = scale
    out = df.withColumns(
        {
            "sla_cost": sla_cost(),
            "energy_cost": clip((energy_raw() - low) / max(high - low, 1e-9), 0.0, 1.0),
            "stability_cost": stability_cost(),
            "current_action": current_action(),
        }
    )
    return out.withColumn(
        "utility",
        utility_of(F.col("sla_cost"), F.col("energy_cost"), F.col("stability_cost"), cfg),
    )
