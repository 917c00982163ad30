"""Candidate actions of a transition row as an array column.

The action catalogue is small (three slices, a few schedulers, at most 275 PRB values), so
fitted estimates become one array per slice and state bin that is joined to the rows from a
size-checked dimension. Rows are never multiplied by actions for scoring or selection;
`explode` is used only where the long form itself is the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylake.config import ObjectiveSettings
from policylake.constants import CONTEXT_COLUMNS
from policylake.functions.core import clip, first_of
from policylake.functions.dims import freeze
from policylake.operators import outcome_model

FALLBACK_WEIGHTS = (0.70, 0.20, 0.10)


def cell_means(rows: DataFrame) -> DataFrame:
    """Mean outcome costs and support per (slice, action)."""
    return rows.groupBy("slice_type", "action").agg(
        F.count(F.lit(1)).alias("support"),
        F.avg("sla_cost").alias("sla"),
        F.avg("energy_cost").alias("energy"),
        F.avg("stability_cost").alias("stability"),
        F.avg("utility").alias("value"),
    )


def min_risk_fallback(cells: DataFrame) -> DataFrame:
    """Per slice the action of least risk; more support wins, then the name."""
    a, b, c = FALLBACK_WEIGHTS
    risk = F.round(a * F.col("sla") + b * F.col("energy") + c * F.col("stability"), 12)
    return cells.groupBy("slice_type").agg(
        F.min_by("action", F.struct(risk, -F.col("support"), F.col("action"))).alias("fallback")
    )


def most_frequent_fallback(rows: DataFrame, common: DataFrame) -> DataFrame:
    """Per slice the most logged action inside the common support, first name on ties."""
    counts = (
        rows.groupBy("slice_type", "action").agg(F.count(F.lit(1)).alias("n"))
        .join(common, ["slice_type", "action"], "right")
    )
    return counts.groupBy("slice_type").agg(
        F.min_by("action", F.struct(-F.coalesce("n", F.lit(0)), F.col("action"))).alias("fallback")
    )


def common_support(policy: DataFrame, evaluator: DataFrame) -> DataFrame:
    """(slice, action) cells that both roles have seen."""
    keys = ["slice_type", "action"]
    return policy.select(*keys).intersect(evaluator.select(*keys))


def fit_cells(policy_rows: DataFrame, evaluator_rows: DataFrame) -> DataFrame:
    """Frozen table of the cells in common support with both roles' means and the action index."""
    policy = cell_means(policy_rows)
    evaluator = cell_means(evaluator_rows).select(
        "slice_type", "action", F.col("sla").alias("e_sla"), F.col("energy").alias("e_energy"),
        F.col("stability").alias("e_stability"),
    )
    joined = policy.join(evaluator, ["slice_type", "action"])
    index = F.dense_rank().over(Window.orderBy("action")) - 1  # over the few catalogue cells
    return freeze(joined.withColumn("idx", index))


def fit_model(policy_rows: DataFrame, evaluator_rows: DataFrame, cfg: ObjectiveSettings | None = None) -> tuple[outcome_model.OutcomeModel, DataFrame]:
    """Estimates of every candidate from both roles' rows, and the cells in common support."""
    cells = fit_cells(policy_rows, evaluator_rows)
    catalogue = cells.join(min_risk_fallback(cells), "slice_type").select("slice_type", "action", "idx", "fallback").collect()
    return outcome_model.fit(policy_rows, evaluator_rows, catalogue, cfg or ObjectiveSettings()), cells


def with_candidates(rows: DataFrame, model: outcome_model.OutcomeModel, fields: list[str]) -> DataFrame:
    """Add `cand` (array of structs in action order), `fallback`, `ood`, `cur` (own cell or null).

    `rows` carry the context columns, which go. A row of a slice without any action in common
    support stops the job; no row vanishes.
    """
    scored = rows.withColumns({"bin": model.scale.bin(), "ood": model.ood()})
    joined = scored.join(model.cells, ["slice_type", "bin"], "left")
    lost = F.raise_error(F.concat(F.lit("no action in common support for slice "), F.coalesce("slice_type", F.lit("null"))))
    joined = joined.withColumn("cells", F.when(F.col("cells").isNotNull(), F.col("cells")).otherwise(lost))
    built = F.transform("cells", lambda c: F.struct(*[c[f].alias(f) for f in ("idx", "action", *fields)]))
    out = joined.withColumn("cand", built).drop("cells", "bin", *CONTEXT_COLUMNS)
    return out.withColumn("cur", first_of(F.filter("cand", lambda c: c["action"] == F.col("current_action"))))


def normalise_q(df: DataFrame) -> DataFrame:
    """Add the span of q over the row's supported actions."""
    return df.withColumns(
        {
            "q_low": F.array_min(F.transform("cand", lambda c: c["q"])),
            "q_high": F.array_max(F.transform("cand", lambda c: c["q"])),
        }
    )


def q_norm(c: Column) -> Column:
    span = F.col("q_high") - F.col("q_low")
    return F.when(span > 1e-9, clip((c["q"] - F.col("q_low")) / span, 0.0, 1.0)).otherwise(0.5)


def score(c: Column, cfg: ObjectiveSettings, planning: bool = True, uncertainty: bool = True) -> Column:
    """1 - weighted cost / weight sum, plus the planning term."""
    unc_w = cfg.uncertainty_weight if uncertainty else 0.0
    total = max(cfg.outcome_weight + unc_w, 1e-9)
    cost = (
        cfg.sla_weight * c["sla"] + cfg.energy_weight * c["energy"]
        + cfg.stability_weight * c["stability"] + unc_w * c["unc"]
    )
    value = 1.0 - cost / total
    return value + cfg.planning_weight * q_norm(c) if planning else value


def with_scores(df: DataFrame, cfg: ObjectiveSettings, **flags: bool) -> DataFrame:
    """Add field `score` to every candidate."""
    return normalise_q(df).withColumn(
        "cand", F.transform("cand", lambda c: c.withField("score", score(c, cfg, **flags)))
    ).withColumn("cur", first_of(F.filter("cand", lambda c: c["action"] == F.col("current_action"))))


def best(candidates: Column, value: Callable[[Column], Column]) -> Column:
    """Candidate of the highest value; values compare at 12 decimals, first index wins ties."""
    ranked = F.transform(
        candidates,
        lambda c: F.struct(F.round(value(c), 12).alias("s"), (-c["idx"]).alias("ni"), c.alias("c")),
    )
    return F.array_max(ranked)["c"]


def prior(c: Column) -> Column:
    """Normalised behaviour probability; needs `w_sum` on the row."""
    return c["w"] / F.col("w_sum")


def with_prior_sum(df: DataFrame) -> DataFrame:
    total = F.aggregate("cand", F.lit(0.0), lambda a, c: a + c["w"])
    return df.withColumn("w_sum", total)
