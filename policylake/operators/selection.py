"""Selection rules over candidate arrays: gated, hysteresis, abstaining and behaviour-aware."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.config import ObjectiveSettings
from policylake.constants import MAX_PRB, SCHEDULERS
from policylake.functions.core import clip, decision_list, finite, first_of, uniform
from policylake.operators.candidates import best, prior, with_scores


def gated_selection(
    df: DataFrame, cfg: ObjectiveSettings, *, safety_gate: bool = True, ood_gate: bool = True, planning: bool = True
) -> DataFrame:
    """Best safe action; own or fallback action when out of distribution or nothing is safe."""
    out = with_scores(df, cfg, planning=planning)
    safe = F.filter(
        "cand", lambda c: (c["sla"] <= cfg.sla_threshold) & (c["unc"] <= cfg.uncertainty_threshold)
    ) if safety_gate else F.col("cand")
    default = first_of(F.filter("cand", lambda c: c["action"] == F.col("fallback")))
    out = out.withColumns(
        {
            "free": best(F.col("cand"), lambda c: c["score"]),
            "gated": best(safe, lambda c: c["score"]),
            "hold": F.coalesce("cur", default),
        }
    )
    far = (F.col("ood") > cfg.ood_threshold) if ood_gate else F.lit(False)
    out = out.withColumn(
        "fallback_reason", decision_list([(far, "ood"), (F.col("gated").isNull(), "safety")], "")
    )
    out = out.withColumn("pick", F.when(F.col("fallback_reason") == "", F.col("gated")).otherwise(F.col("hold")))
    differs = F.col("pick.action") != F.col("free.action")
    return out.withColumns(
        {
            "selected_action": F.col("pick.action"),
            "unconstrained_action": F.col("free.action"),
            "rollback": F.col("fallback_reason") != "",
            "safety_override": (F.col("fallback_reason") != "ood") & differs,
            "churn": F.col("pick.action") != F.col("current_action"),
            "agreement": F.col("pick.action") == F.col("action"),
            "direct_utility": outcome_utility(F.col("pick"), cfg, ""),
        }
    )


def outcome_utility(c: Column, cfg: ObjectiveSettings, prefix: str) -> Column:
    cost = (
        cfg.sla_weight * c[f"{prefix}sla"] + cfg.energy_weight * c[f"{prefix}energy"]
        + cfg.stability_weight * c[f"{prefix}stability"]
    )
    return 1.0 - cost / cfg.outcome_weight


def hysteresis_selection(
    df: DataFrame, cfg: ObjectiveSettings, margin: float, *, proposal: Column | None = None,
    safety: bool = True, ood: bool = True, uncertainty: bool = True, hysteresis: bool = True,
) -> DataFrame:
    """Gated selection that keeps the own action unless the gain reaches the margin.

    With `proposal` the named action is taken instead of the best one, under the same gates.
    """
    out = with_scores(df, cfg, uncertainty=uncertainty)

    def is_safe(c: Column) -> Column:
        if not safety:
            return finite(c["score"])
        return finite(c["score"]) & (c["sla"] <= cfg.sla_threshold) & (c["unc"] <= cfg.uncertainty_threshold)

    pool = F.filter("cand", is_safe)
    if proposal is not None:
        wanted = proposal
        pool = F.filter(pool, lambda c: c["action"] == wanted)
    default = first_of(F.filter("cand", lambda c: c["action"] == F.col("fallback")))
    out = out.withColumns({"gated": best(pool, lambda c: c["score"]), "hold": F.coalesce("cur", default)})
    far = (F.col("ood") > cfg.ood_threshold) if ood else F.lit(False)
    out = out.withColumn("rollback", far | F.col("gated").isNull())
    gain = F.round(F.col("gated.score") - F.col("cur.score"), 12)
    held = (
        ~F.col("rollback") & F.col("cur").isNotNull() & (F.col("gated.idx") != F.col("cur.idx"))
        & (gain < margin) if hysteresis else F.lit(False)
    )
    out = out.withColumn("held", F.coalesce(held, F.lit(False)))
    reason = decision_list(
        [(far, "ood"), (F.col("gated").isNull(), "safety"), (F.col("held"), "hysteresis")], ""
    )
    pick = F.when(F.col("rollback"), F.col("hold")).when(F.col("held"), F.col("cur")).otherwise(F.col("gated"))
    out = out.withColumns({"fallback_reason": reason, "pick": pick})
    return out.withColumn("selected_action", F.col("pick.action"))


# ---- abstaining re-rank --------------------------------------------------------------------

def feasible(c: Column, max_sla: float, max_unc: float) -> Column:
    """Supported and within both gates."""
    return c["sup"] & (c["sla"] <= max_sla) & (c["unc"] <= max_unc)


def rankable(c: Column, max_sla: float, max_unc: float) -> Column:
    """Feasible with a finite score; NaN would sort above every score."""
    return feasible(c, max_sla, max_unc) & finite(c["score"])


def incumbent_idx() -> Column:
    return F.coalesce("cur.idx", F.lit(-1))


def switched_score(c: Column, cost: float) -> Column:
    return c["score"] - F.when(c["idx"] != incumbent_idx(), cost).otherwise(0.0)


def rerank(df: DataFrame, max_sla: float = 0.45, max_unc: float = 0.5, switch_cost: float = 0.0) -> DataFrame:
    """Best eligible action or nothing; `df` must carry scored candidates with `sup`."""
    out = df.withColumn("valid", F.filter("cand", lambda c: rankable(c, max_sla, max_unc)))
    return out.withColumns(
        {
            "chosen": best(F.col("valid"), lambda c: switched_score(c, switch_cost)),
            "original": best(F.col("cand"), lambda c: c["score"]),
            "eligible": F.size("valid"),
        }
    ).withColumns(
        {
            "abstain": F.col("eligible") == 0,
            "overridden": F.coalesce(F.col("chosen.idx") != F.col("original.idx"), F.lit(False)),
        }
    )


# ---- behaviour-aware modes -----------------------------------------------------------------

BEHAVIOUR_MODES = ["boltzmann", "behavior_clone", "behavior_kl", "behavior_tree"]


def behaviour_selection(
    df: DataFrame, mode: str, *, temperature: float = 0.05, behavior_weight: float = 0.5,
    min_prob: float = 0.01, max_sla: float = 0.5, max_unc: float = 0.6,
    switch_cost: float = 0.01, hold_margin: float = 0.02, seed: str = "2026",
) -> DataFrame:
    """Adds chosen_idx (-1 abstains), eligible, reason; needs scores, `sup`, `w` and `w_sum`."""
    if mode not in BEHAVIOUR_MODES:
        raise ValueError(f"unknown behaviour mode: {mode}")

    def adj(c: Column) -> Column:
        return switched_score(c, switch_cost)

    ok = F.filter("cand", lambda c: rankable(c, max_sla, max_unc))
    out = df.withColumn("valid", ok)
    reason = F.lit("selected")
    empty = F.lit("no_eligible_action")
    if mode in ("behavior_clone", "behavior_kl"):  # an action never logged has no prior to follow
        out = out.withColumns({"safe": F.size("valid"), "valid": F.filter("valid", lambda c: prior(c) > 0)})
        empty = F.when(F.col("safe") > 0, "no_behavior_prior").otherwise(empty)
    if mode == "boltzmann":
        out = out.withColumn("peak", F.array_max(F.transform("valid", adj)))
        out = out.withColumn(
            "mass", F.transform("valid", lambda c: F.exp((adj(c) - F.col("peak")) / temperature))
        )
        out = out.withColumns(
            {
                "z": F.aggregate("mass", F.lit(0.0), lambda a, x: a + x),
                "draw": uniform("boltzmann", F.lit(seed), F.col("row_id")),
            }
        )
        walk = F.aggregate(
            F.arrays_zip("valid", "mass"),
            F.struct(F.lit(0.0).alias("cdf"), F.lit(-1).alias("idx")),
            lambda a, x: F.struct(
                (a["cdf"] + x["mass"] / F.col("z")).alias("cdf"),
                F.when(a["cdf"] < F.col("draw"), x["valid"]["idx"]).otherwise(a["idx"]).alias("idx"),
            ),
        )
        chosen = walk["idx"]
    elif mode == "behavior_clone":
        out = out.withColumn("chosen", best(F.col("valid"), prior))
        chosen = F.col("chosen.idx")
    elif mode == "behavior_kl":
        heat = temperature * max(behavior_weight, 1e-8)
        out = out.withColumn("chosen", best(F.col("valid"), lambda c: adj(c) / heat + F.ln(prior(c))))
        chosen = F.col("chosen.idx")
    else:
        out = out.withColumn("valid", F.filter("valid", lambda c: prior(c) >= min_prob))
        own = first_of(F.filter("valid", lambda c: c["idx"] == incumbent_idx()))
        out = out.withColumns({"chosen": best(F.col("valid"), adj), "own": own})
        hold = F.coalesce(
            F.round(F.col("own.score"), 12) >= F.round(adj(F.col("chosen")) - hold_margin, 12), F.lit(False)
        )
        chosen = F.when(hold, F.col("own.idx")).otherwise(F.col("chosen.idx"))
        reason = F.when(hold, "verified_hold").otherwise("selected")
    none = F.size("valid") == 0
    return out.select(
        *df.columns,
        F.lit(mode).alias("mode"),
        F.when(none, -1).otherwise(chosen).alias("chosen_idx"),
        F.size("valid").alias("eligible"),
        F.when(none, empty).otherwise(reason).alias("reason"),
    )


# ---- safe improvement ----------------------------------------------------------------------

IMPROVEMENT_MODES = [
    "advantage_lcb", "constraint_conditioned", "behavior_anchored_lcb", "verified_hold", "hint_guided",
]


def action_names(most_prb: int = MAX_PRB) -> list[str]:
    """Every action a scheduler can be given."""
    return [f"{s}:prb={n}" for s in SCHEDULERS.values() for n in range(most_prb + 1)]


def checked_hints(hints: dict[str, float], actions: list[str], limit: float = 0.25) -> dict[str, float]:
    """Bounded external hints on known actions only."""
    unknown = sorted(set(hints) - set(actions))
    if unknown:
        raise ValueError(f"hints name unknown actions: {unknown}")
    if any(not abs(v) <= limit for v in hints.values()):
        raise ValueError("hints must be finite and bounded")
    return dict(hints)


def hint_value(c: Column, hints: dict[str, float]) -> Column:
    return decision_list([(c["action"] == a, float(v)) for a, v in hints.items()], 0.0)


def safe_improvement(
    df: DataFrame, mode: str, *, max_sla: float = 0.5, max_unc: float = 0.6, penalty: float = 0.2,
    switch_cost: float = 0.01, risk_weight: float = 0.2, behavior_weight: float = 0.05,
    min_prob: float = 0.005, hints: dict[str, float] | None = None, hint_weight: float = 0.5,
) -> DataFrame:
    """Adds chosen_idx (-1 abstains), eligible, reason, switched."""
    if mode not in IMPROVEMENT_MODES:
        raise ValueError(f"unknown improvement mode: {mode}")
    if mode == "hint_guided" and hints is None:
        raise ValueError("hint-guided mode needs hints")

    def adj(c: Column) -> Column:
        value = c["score"]
        if mode == "constraint_conditioned":
            value = value - risk_weight * (
                0.7 * F.pow(clip(c["sla"] / max_sla, 0.0, 1.0), 2)
                + 0.3 * F.pow(clip(c["unc"] / max_unc, 0.0, 1.0), 2)
            )
        if mode == "behavior_anchored_lcb":
            value = value + behavior_weight * F.ln(F.greatest(prior(c), F.lit(1e-12)))
        if mode == "hint_guided":
            value = value + hint_weight * hint_value(c, hints)
        return value - F.when(c["idx"] != incumbent_idx(), switch_cost).otherwise(0.0)

    out = df.withColumn("valid", F.filter("cand", lambda c: rankable(c, max_sla, max_unc)))
    out = out.withColumn("verified", F.exists("valid", lambda c: c["idx"] == incumbent_idx()))
    if mode == "behavior_anchored_lcb":
        out = out.withColumn("valid", F.filter("valid", lambda c: prior(c) >= min_prob))
    out = out.withColumn("chosen", best(F.col("valid"), adj))
    none = F.size("valid") == 0
    if mode in ("advantage_lcb", "behavior_anchored_lcb", "verified_hold"):
        factor = 1.5 * penalty if mode == "verified_hold" else penalty
        cost = factor * F.sqrt(F.pow(F.col("chosen.unc"), 2) + F.pow(F.col("cur.unc"), 2))
        wins = F.round(adj(F.col("chosen")), 12) > F.round(adj(F.col("cur")) + cost, 12)
        switch = (F.col("chosen.idx") != incumbent_idx()) & wins
        result = F.when(none | ~F.col("verified"), -1).when(switch, F.col("chosen.idx")).otherwise(incumbent_idx())
        reason = decision_list(
            [(none, "no_eligible_action"), (~F.col("verified"), "unverified_incumbent"), (~switch, "verified_hold")],
            "selected",
        )
    else:
        result = F.when(none, -1).otherwise(F.col("chosen.idx"))
        reason = F.when(none, "no_eligible_action").otherwise("selected")
    out = out.withColumn("chosen_idx", result)
    return out.select(
        *df.columns, F.lit(mode).alias("mode"), "chosen_idx", F.size("valid").alias("eligible"),
        reason.alias("reason"),
        ((F.col("chosen_idx") >= 0) & (F.col("chosen_idx") != incumbent_idx())).alias("switched"),
    )


# ---- hybrid profiles -----------------------------------------------------------------------

@dataclass(frozen=True)
class HybridProfile:
    name: str
    risk_weight: float = 0.0
    behavior_weight: float = 0.0
    switch_extra: float = 0.0
    hold_margin: float = 0.0
    ood_risk_weight: float = 0.0


# fixed values: the nine profiles of the hybrid search
HYBRID_PROFILES = [
    HybridProfile("conformal_anchor"),
    HybridProfile("slice_risk_light", risk_weight=0.025),
    HybridProfile("slice_risk", risk_weight=0.075, ood_risk_weight=0.5),
    HybridProfile("slice_risk_strong", risk_weight=0.15, ood_risk_weight=1.0),
    HybridProfile("behavior_anchor", behavior_weight=0.01),
    HybridProfile("behavior_risk", risk_weight=0.025, behavior_weight=0.02),
    HybridProfile("incumbent_hysteresis", hold_margin=0.01),
    HybridProfile("adaptive_balanced", 0.05, 0.01, 0.01, 0.01, 0.5),
    HybridProfile("adaptive_conservative", 0.10, 0.02, 0.02, 0.02, 1.0),
]


def hybrid_choice(
    p: HybridProfile, max_sla: float, max_unc: float, max_ood: float, base_cost: float
) -> Column:
    """Struct of one profile's choice on a scored row; `valid` must hold the eligible candidates."""
    def adj(c: Column) -> Column:
        value = c["score"]
        if p.risk_weight:
            factor = decision_list([(F.col("slice_type") == "URLLC", 1.5), (F.col("slice_type") == "mMTC", 1.0)], 0.65)
            pressure = (
                0.7 * F.pow(clip(c["sla"] / max_sla, 0.0, 2.0), 2)
                + 0.3 * F.pow(clip(c["unc"] / max_unc, 0.0, 2.0), 2)
            )
            far = 1 + p.ood_risk_weight * clip(F.col("ood") / max_ood, 0.0, 1.0)
            value = value - p.risk_weight * pressure * factor * far
        if p.behavior_weight:
            value = value + p.behavior_weight * F.ln(clip(prior(c), 0.02, 1.0))
        cost = F.lit(base_cost)
        if p.switch_extra:
            cost = cost + p.switch_extra * clip(c["unc"] / max_unc, 0.0, 1.0)
        return value - F.when(c["idx"] != incumbent_idx(), cost).otherwise(0.0)

    ranked = F.array_max(
        F.transform("valid", lambda c: F.struct(F.round(adj(c), 12).alias("s"), (-c["idx"]).alias("ni")))
    )
    if not p.hold_margin:
        return -ranked["ni"]
    own = F.array_max(
        F.transform(
            F.filter("valid", lambda c: c["idx"] == incumbent_idx()), lambda c: F.round(adj(c), 12)
        )
    )
    keep = F.coalesce(ranked["s"] <= F.round(own + p.hold_margin, 12), F.lit(False))
    return F.when(keep, incumbent_idx()).otherwise(-ranked["ni"])


def hybrid_selection(
    df: DataFrame, profiles: list[HybridProfile], max_sla: float = 0.5, max_unc: float = 0.6,
    max_ood: float = 0.9, base_cost: float = 0.01,
) -> DataFrame:
    """One row per (row, profile); the candidate gate is evaluated once for all profiles."""
    ok = F.filter("cand", lambda c: rankable(c, max_sla, max_unc) & (F.col("ood") <= max_ood))
    out = df.withColumn("valid", ok)
    out = out.withColumn("own_ok", F.exists("valid", lambda c: c["idx"] == incumbent_idx()))
    choices = F.array(
        *[
            F.struct(F.lit(p.name).alias("profile"),
                     F.coalesce(hybrid_choice(p, max_sla, max_unc, max_ood, base_cost), F.lit(-1)).alias("chosen_idx"))
            for p in profiles
        ]
    )
    long = out.select(*df.columns, "own_ok", F.size("valid").alias("eligible"), F.inline(choices))
    acts = F.col("chosen_idx") >= 0
    same = F.col("chosen_idx") == incumbent_idx()
    return long.withColumns(
        {"abstain": ~acts, "switched": acts & ~same, "verified_hold": acts & F.col("own_ok") & same}
    )
