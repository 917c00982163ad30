"""Metrics and accounting of selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.config import ObjectiveSettings
from policylake.functions.core import cond_rate, first_of, rounded
from policylake.functions.dims import constant
from policylake.operators.quantiles import quantiles
from policylake.operators.selection import feasible, gated_selection, incumbent_idx, outcome_utility
from policylake.operators.windows import replay_switches


def policy_metrics(df: DataFrame, groups: list[str], cfg: ObjectiveSettings) -> DataFrame:
    """All evaluation rates and means of a gated selection in one aggregate."""
    c = F.col
    m = {
        "logged_sla_violation_rate": cond_rate(c("sla_cost") > cfg.sla_threshold),
        "logged_energy": F.avg("energy_cost"),
        "logged_stability": F.avg("stability_cost"),
        "logged_utility": F.avg("utility"),
        "sla_violation_rate": cond_rate(c("pick.sla") > cfg.sla_threshold),
        "energy": F.avg("pick.energy"),
        "stability": F.avg("pick.stability"),
        "mean_utility": F.avg("direct_utility"),
        "uplift": F.avg(c("direct_utility") - c("utility")),
        "churn_rate": cond_rate(c("churn")),
        "rollback_rate": cond_rate(c("rollback")),
        "ood_fallback_rate": cond_rate(c("fallback_reason") == "ood"),
        "safety_fallback_rate": cond_rate(c("fallback_reason") == "safety"),
        "override_rate": cond_rate(c("safety_override")),
        "agreement_rate": cond_rate(c("agreement")),
        "mean_ood": F.avg("ood"),
        "mean_uncertainty": F.avg("pick.unc"),
    }
    if "episode_id" in groups:
        extra = [F.lit(1).cast("long").alias("episodes")]
    else:
        extra = [F.countDistinct("episode_id").alias("episodes")]
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"), *extra, *[rounded(e).alias(k) for k, e in m.items()]
    )


def with_split_quantile(
    metrics: DataFrame, rows: DataFrame, group: str, value: str, prob: float, name: str
) -> DataFrame:
    """Add an exact, linear-interpolated quantile per group, for any number of groups."""
    found = quantiles(rows.where(F.col(group).isNotNull()), [group], {value: [prob]})
    return metrics.join(found.select(group, rounded(f"{value}_0").alias(name)), group)


def ablation_table(rows: DataFrame, cfg: ObjectiveSettings, variants: dict[str, dict]) -> DataFrame:
    """One summary row per variant of the gates."""
    out = None
    for name, flags in variants.items():
        g = gated_selection(rows, cfg, **flags)
        part = g.agg(
            F.lit(name).alias("variant"), F.count(F.lit(1)).alias("n"),
            rounded(F.avg("direct_utility")).alias("mean_utility"),
            rounded(cond_rate(F.col("rollback"))).alias("rollback_rate"),
            rounded(cond_rate(F.col("churn"))).alias("churn_rate"),
            rounded(cond_rate(F.col("pick.sla") > cfg.sla_threshold)).alias("sla_violation_rate"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def score_selection(picked: DataFrame, cfg: ObjectiveSettings) -> DataFrame:
    """Independent evaluator's costs of the selected action, with replay switches."""
    out = picked.withColumns(
        {
            "e_sla": F.col("pick.e_sla"), "e_energy": F.col("pick.e_energy"), "e_stability": F.col("pick.e_stability"),
            "e_utility": outcome_utility(F.col("pick"), cfg, "e_"),
        }
    ).drop("cand", "cells", "gated", "hold", "cur", "pick")
    return replay_switches(out, "selected_action")


def selection_summary(scored: DataFrame, groups: list[str], cfg: ObjectiveSettings) -> DataFrame:
    pairs = F.count("previous_action")
    return scored.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.avg("e_utility")).alias("utility"),
        rounded(cond_rate(F.col("e_sla") > cfg.sla_threshold)).alias("sla_violation_rate"),
        rounded(F.avg("e_energy")).alias("energy"),
        rounded(F.avg("e_stability")).alias("stability"),
        rounded(F.count_if("switch") / F.greatest(pairs, F.lit(1))).alias("replay_switch_rate"),
        pairs.alias("replay_transitions"),
        rounded(cond_rate(F.col("selected_action") != F.col("current_action"))).alias("disagreement_rate"),
        rounded(cond_rate(F.col("rollback"))).alias("rollback_rate"),
    )


def logged_summary(targets: DataFrame, groups: list[str], cfg: ObjectiveSettings) -> DataFrame:
    """The same summary for the logged actions and their observed outcomes."""
    t = replay_switches(targets, "action")
    pairs = F.count("previous_action")
    return t.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.avg("utility")).alias("utility"),
        rounded(cond_rate(F.col("sla_cost") > cfg.sla_threshold)).alias("sla_violation_rate"),
        rounded(F.avg("energy_cost")).alias("energy"),
        rounded(F.avg("stability_cost")).alias("stability"),
        rounded(F.count_if("switch") / F.greatest(pairs, F.lit(1))).alias("replay_switch_rate"),
        rounded(cond_rate(F.col("current_action") != F.col("action"))).alias("disagreement_rate"),
    )


def decision_values(reranked: DataFrame, cfg: ObjectiveSettings) -> DataFrame:
    """The seven aligned columns of cluster accounting from an abstaining re-rank."""
    reference = first_of(F.filter("cand", lambda c: c["action"] == F.col("fallback")))
    own = first_of(F.filter("cand", lambda c: c["idx"] == incumbent_idx()))
    return reranked.withColumns({"ref": reference, "own": own}).select(
        "row_id", "scenario", "training_config", "experiment", "base_station", "slice_type",
        (~F.col("abstain")).alias("accepted"),
        outcome_utility(F.col("chosen"), cfg, "e_").alias("selected_dm"),
        outcome_utility(F.col("ref"), cfg, "e_").alias("reference_dm"),
        outcome_utility(F.col("own"), cfg, "e_").alias("incumbent_dm"),
        F.coalesce("own.sup", F.lit(False)).alias("incumbent_supported"),
        (F.col("action") == F.col("current_action")).alias("logged_incumbent"),
        F.col("utility").alias("logged_observed"),
    )


def gate_funnel(
    rows: DataFrame, groups: list[str], max_ood: float, max_sla: float, max_unc: float
) -> DataFrame:
    """Share of rows that keep at least one candidate after each gate."""
    near = F.col("ood") <= max_ood

    def some(test) -> Column:
        return cond_rate(near & F.exists("cand", test))

    return rows.groupBy(*groups).agg(
        rounded(some(lambda c: F.lit(True))).alias("slice_ood"),
        rounded(some(lambda c: (c["sla"] <= max_sla) & (c["unc"] <= max_unc))).alias("risk"),
        rounded(some(lambda c: c["sup"])).alias("support"),
        rounded(some(lambda c: feasible(c, max_sla, max_unc))).alias("joint"),
    )


def profile_statistics(h: DataFrame, cfg: ObjectiveSettings, abstention: float = -0.12) -> DataFrame:
    """Coverage, unconditional score, conditional risk and switch rate per profile."""
    c = first_of(F.filter("cand", lambda x: x["idx"] == F.col("chosen_idx")))
    s = h.withColumn("c", c)
    acts = ~F.col("abstain")
    return s.groupBy("profile").agg(
        cond_rate(acts).alias("coverage"),
        F.avg(F.when(acts, outcome_utility(F.col("c"), cfg, "e_")).otherwise(abstention)).alias("score"),
        F.avg(F.when(acts, F.when(F.col("c.e_sla") > cfg.sla_threshold, 1.0).otherwise(0.0))).alias("risk"),
        cond_rate(F.col("switched")).alias("switch_rate"),
    )
