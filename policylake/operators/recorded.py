"""Projection by recorded per-policy deltas, with the impact projection as fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.operators import governed

RECORDED_UNCERTAINTY = 0.24


def project(df: DataFrame, deltas: dict[str, dict[str, float]], horizon: int = 3) -> DataFrame:
    """Final KPIs per snapshot and policy. A delta of step k is divided by k + 1."""
    def recorded_state(policy: str) -> Column:
        cols = []
        for name in governed.STATE:
            value = F.col(name).cast("double")
            for step in range(horizon):
                if name in deltas[policy]:
                    value = value + deltas[policy][name] * (1.0 / (step + 1))
                if name in ("prb_utilization", "energy_load"):
                    value = F.least(F.lit(1.5), F.greatest(F.lit(0.0), value))
            cols.append(F.round(value, 6).alias(name))
        return F.struct(F.lit(policy).alias("policy"), *cols, F.lit(RECORDED_UNCERTAINTY).alias("uncertainty"))

    def fallback_state(p: Column) -> Column:
        k = governed.final_kpis(p, horizon)
        return F.struct(
            p["policy"].alias("policy"), *[k[n].alias(n) for n in governed.STATE],
            F.lit(governed.twin_uncertainty(horizon)).alias("uncertainty"),
        )

    without = F.filter(governed.policy_array(), lambda p: ~p["policy"].isin(list(deltas)))
    rows = F.concat(F.transform(without, fallback_state), F.array(*[recorded_state(p) for p in deltas]))
    return df.select("event_id", F.inline(rows))
