"""Validation-only calibration: the controller grid and profile choice."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.config import CalibrationConfig, ObjectiveSettings
from policylake.functions.core import cond_rate, first_of, rounded
from policylake.functions.dims import constant, freeze
from policylake.operators.candidates import normalise_q, q_norm
from policylake.operators.history import previous_value, time_bucket
from policylake.operators.selection import outcome_utility


def grid_points(science: CalibrationConfig) -> list[tuple[float, float, float, float]]:
    return list(product(science.sla_grid, science.uncertainty_grid, science.planning_grid, science.margin_grid))


def calibration_table(
    rows: DataFrame, cfg: ObjectiveSettings, science: CalibrationConfig, ood_limit: float, observed_sla: float
) -> DataFrame:
    """One row per grid point with its validation metrics, score and feasibility.

    Every row evaluates the whole grid on its own candidate array; the choices travel as one
    small integer array, so the replay needs one look-back for all points and the only
    shuffle after it is the aggregate over at most 108 grid ids.
    """
    points = grid_points(science)
    weight = max(cfg.immediate_weight, 1e-9)

    def base_score(c: Column) -> Column:
        cost = (
            cfg.sla_weight * c["sla"] + cfg.energy_weight * c["energy"]
            + cfg.stability_weight * c["stability"] + cfg.uncertainty_weight * c["unc"]
        )
        return 1.0 - cost / weight

    r = normalise_q(rows).withColumn(
        "cand",
        F.transform(
            "cand", lambda c: c.withField("base", base_score(c)).withField("qn", q_norm(c))
        ),
    )
    r = r.withColumns(
        {
            "cand": F.transform(
                "cand", lambda c: c.dropFields("energy", "stability", "q")
                .withField("e_u", outcome_utility(c, cfg, "e_")).dropFields("e_energy", "e_stability")
            ),
            "own_idx": F.coalesce("cur.idx", F.lit(-1)),
            "hold_idx": F.coalesce(
                "cur.idx", first_of(F.filter("cand", lambda c: c["action"] == F.col("fallback")))["idx"]
            ),
            "far": F.col("ood") > ood_limit,
        }
    )

    def ranked(g_sla: float, g_unc: float, g_plan: float) -> Column:
        safe = F.filter("cand", lambda c: (c["sla"] <= g_sla) & (c["unc"] <= g_unc))
        return F.array_max(
            F.transform(
                safe,
                lambda c: F.struct(
                    F.round(c["base"] + g_plan * c["qn"], 12).alias("s"), (-c["idx"]).alias("ni"),
                    (c["base"] + g_plan * c["qn"]).alias("raw"),
                ),
            )
        )

    triples = list(dict.fromkeys((a, b, p) for a, b, p, _ in points))
    r = r.withColumn("bests", F.array(*[ranked(*t) for t in triples]))
    r = r.withColumn(
        "own_c", first_of(F.filter("cand", lambda c: c["idx"] == F.col("own_idx")))
    )

    grid = F.array(
        *[
            F.struct(F.lit(i).alias("gid"), F.lit(triples.index((a, b, p))).alias("t"), F.lit(p).alias("plan"), F.lit(m).alias("margin"))
            for i, (a, b, p, m) in enumerate(points)
        ]
    )

    def choose_one(g: Column) -> Column:
        b = F.get(F.col("bests"), g["t"])
        own = F.col("own_c.base") + g["plan"] * F.col("own_c.qn")
        near = (F.col("own_idx") >= 0) & (-b["ni"] != F.col("own_idx")) & (F.round(b["raw"] - own, 12) < g["margin"])
        return (
            F.when(F.col("far") | b.isNull(), F.col("hold_idx"))
            .when(F.coalesce(near, F.lit(False)), F.col("own_idx"))
            .otherwise(-b["ni"])
        )

    r = r.withColumns(
        {
            "sel": F.transform(grid, lambda g: choose_one(g)),
            "rolled": F.transform("bests", lambda b: F.col("far") | b.isNull()),
        }
    )
    r = previous_value(
        r.select("episode_id", "timestamp_s", "sel", "rolled",
                 F.map_from_arrays(F.transform("cand", lambda c: c["idx"]), F.transform("cand", lambda c: F.struct(c["e_sla"].alias("e_sla"), c["e_u"].alias("e_u")))).alias("ev")),
        ["episode_id"], ["timestamp_s"], time_bucket("timestamp_s", 3600.0), F.col("sel"), "prev_sel",
    )
    t_of = F.array(*[F.lit(triples.index((a, b, p))) for a, b, p, _ in points])
    long = r.select(
        F.posexplode("sel").alias("gid", "choice"), "rolled", "prev_sel", "ev"
    ).select(
        "gid", "choice",
        F.get("rolled", F.get(t_of, F.col("gid"))).alias("rollback"),
        F.get("prev_sel", F.col("gid")).alias("prev"),
        F.element_at("ev", F.col("choice")).alias("e"),
    )
    stats = long.groupBy("gid").agg(
        F.avg("e.e_u").alias("utility"),
        cond_rate(F.col("e.e_sla") > science.reference_sla_threshold).alias("sla_violation"),
        (F.count_if(F.col("prev") != F.col("choice")) / F.greatest(F.count("prev"), F.lit(1))).alias("churn"),
        cond_rate(F.col("rollback")).alias("rollback"),
    )
    value = (
        F.col("utility") - science.sla_penalty * F.col("sla_violation")
        - science.churn_penalty * F.col("churn") - science.rollback_penalty * F.col("rollback")
    )
    dim = constant(
        rows.sparkSession, [(i, *p) for i, p in enumerate(points)],
        "gid int, g_sla double, g_unc double, g_plan double, g_margin double",
    )
    out = stats.join(dim, "gid").withColumns(
        {"score": value, "feasible": F.col("sla_violation") <= observed_sla + science.max_sla_regression}
    )
    return out.select(
        "gid", "g_sla", "g_unc", "g_plan", "g_margin",
        *[rounded(c).alias(c) for c in ("utility", "sla_violation", "churn", "rollback", "score")], "feasible",
    )


def choose(table: DataFrame) -> DataFrame:
    """Best feasible point, or the best of all with the flag lowered when none is feasible."""
    table = freeze(table, 4096)
    any_ok = table.agg(F.max("feasible").alias("ok")).scalar()
    pool = table.withColumn("constraint_feasible", any_ok).filter(
        F.col("feasible") | ~F.col("constraint_feasible")
    )
    return (
        pool.orderBy(F.desc("score"), "sla_violation", "churn", "gid")
        .limit(1)
        .select("gid", "score", "constraint_feasible")
    )


def choose_profile(
    stats: DataFrame, anchor: str, coverage_fraction: float = 0.995,
    max_regression: float = 0.0025, min_gain: float = 0.00025,
) -> DataFrame:
    """Best profile that beats the anchor on validation, else the anchor."""
    stats = freeze(stats, 4096)
    a = stats.filter(F.col("profile") == anchor)
    limits = {n: a.select(n).scalar() for n in ("coverage", "risk", "score")}
    ok = (
        (F.col("coverage") >= F.greatest(F.lit(0.05), limits["coverage"] * coverage_fraction))
        & (F.col("risk") <= limits["risk"] + max_regression)
        & (F.col("score") >= limits["score"] + min_gain)
    )
    flagged = stats.withColumn("beats_anchor", F.coalesce(ok, F.lit(False)))
    return (
        flagged.filter(F.col("beats_anchor") | (F.col("profile") == anchor))
        .orderBy(
            F.desc("beats_anchor"), F.desc(F.round("score", 12)), F.round("switch_rate", 12),
            F.round("risk", 12), "profile",
        )
        .limit(1)
    )
