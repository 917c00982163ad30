"""Validation rules, audits and gate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.constants import CELL_COLUMNS, KPI_RANGES, SLICE_NAMES, STATE_COLUMNS
from policylake.functions.core import any_of, cond_rate, finite, reasons
from policylake.functions.dims import constant
from policylake.operators.history import previous_value, time_bucket
from policylake.operators.outcomes import current_action


def kpi_errors() -> Column:
    """Names of the KPI rules a snapshot breaks."""
    rules = [(~finite(F.col(c).cast("double")) | ~F.col(c).between(lo, hi), c) for c, (lo, hi) in KPI_RANGES.items()]
    rules += [
        (F.col("cell_id").isNull() | ~F.length("cell_id").between(1, 128), "cell_id"),
        (F.col("slice_type").isNull() | ~F.col("slice_type").isin(SLICE_NAMES), "slice_type"),
        (F.col("telemetry_age_ms") < 0, "telemetry_age_ms"),
        (~F.col("telemetry_completeness").between(0, 1), "telemetry_completeness"),
    ]
    return reasons(*[(F.coalesce(c, F.lit(True)), name) for c, name in rules])


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows with their list of broken rules."""
    checked = df.withColumn("errors", kpi_errors())
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def gate_table(facts: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """One row per gate from a one-row table of facts."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("gate"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in gates.items()]
    )
    return facts.select(F.inline(pairs))


def verdict(passed: Column, total: Column) -> Column:
    return (
        F.when(passed == total, "ready")
        .when(passed == total - 1, "nearly ready")
        .otherwise("not ready")
    )


def transition_gates(df: DataFrame) -> DataFrame:
    """Six structural gates of a transition table, from two aggregates."""
    numeric = [*STATE_COLUMNS, *[f"next_{c}" for c in STATE_COLUMNS], "reward"]
    broken = any_of(*[~finite(c) for c in numeric])
    rows = df.agg(
        F.count_if(F.col("split") == "train").alias("train_rows"),
        F.count_if(F.col("split") == "test").alias("test_rows"),
        F.count_if(broken).alias("broken"),
    )
    actions = (
        df.groupBy("action")
        .agg(F.max(F.col("split") == "train").alias("seen"))
        .agg(F.count_if("seen").alias("actions"), F.count_if(~F.col("seen")).alias("unsupported"))
    )
    shared = (
        df.groupBy("episode_id")
        .agg(F.min("split").alias("a"), F.max("split").alias("b"))
        .agg(F.count_if(F.col("a") != F.col("b")).alias("shared"))
    )
    facts = rows.withColumns(
        {
            "actions": actions.select("actions").scalar(),
            "unsupported": actions.select("unsupported").scalar(),
            "shared": shared.scalar(),
        }
    )
    return gate_table(
        facts,
        {
            "train_rows": F.col("train_rows") >= 100,
            "test_rows": F.col("test_rows") >= 100,
            "three_actions": F.col("actions") >= 3,
            "episodes_disjoint": F.col("shared") == 0,
            "held_out_actions_supported": F.col("unsupported") == 0,
            "finite": F.col("broken") == 0,
        },
    )


def overlap_audit(df: DataFrame, unit: str, split: str, splits: list[str]) -> DataFrame:
    """Units shared by each pair of splits, zero-filled."""
    names = sorted(splits)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    dim = constant(df.sparkSession, pairs, "left_split string, right_split string")
    members = df.groupBy(unit).agg(F.sort_array(F.collect_set(split)).alias("s"))
    found = (
        members.filter(F.size("s") > 1)
        .select(F.explode("s").alias("left_split"), "s")
        .select("left_split", F.explode("s").alias("right_split"))
        .filter(F.col("left_split") < F.col("right_split"))
        .groupBy("left_split", "right_split")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        dim.join(found, ["left_split", "right_split"], "left")
        .select("left_split", "right_split", F.coalesce("n", F.lit(0)).alias("overlap"))
    )


def unsupported_actions(train: DataFrame, test: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Held-out actions never seen in training, by group of held-out rows."""
    return test.select(*(groups or []), "action").distinct().join(train.select("action").distinct(), "action", "left_anti")


def transition_audit(df: DataFrame) -> DataFrame:
    """Scheduler, PRB and joint changes per cell of the experiment grid."""
    moved = df.withColumns(
        {
            "joint": current_action() != F.col("action"),
            "sched": F.rint("scheduler_code") != F.rint("next_scheduler_code"),
            "prb": F.rint("slice_prb") != F.rint("next_slice_prb"),
        }
    )
    return moved.groupBy(*CELL_COLUMNS).agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("episode_id").alias("episodes"),
        F.countDistinct(F.rint("scheduler_code")).alias("unique_scheduler"),
        F.countDistinct(F.rint("slice_prb")).alias("unique_prb"),
        F.count_if("sched").alias("scheduler_change_rows"),
        F.count_if("prb").alias("prb_change_rows"),
        F.count_if("joint").alias("joint_action_change_rows"),
        cond_rate(F.col("joint")).alias("joint_action_change_rate"),
    )


def recorded_action_changes(
    df: DataFrame, tie_break: list[str], bucket_seconds: float = 3600.0
) -> DataFrame:
    """Flag changes between adjacent records; only a strictly later time counts."""
    prev = previous_value(
        df, ["episode_id", "slice_type"], ["timestamp_s", *tie_break],
        time_bucket("timestamp_s", bucket_seconds),
        F.struct("action", "timestamp_s"), "__prev",
    )
    later = F.col("timestamp_s") > F.col("__prev.timestamp_s")
    return prev.withColumns(
        {
            "adjacent_change": F.coalesce((F.col("action") != F.col("__prev.action")) & later, F.lit(False)),
            "timestamp_tie": F.coalesce(~later, F.lit(False)),
        }
    ).drop("__prev")


def recorded_action_audit(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy(*CELL_COLUMNS, "slice_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("episode_id").alias("episodes"),
        F.countDistinct("action").alias("distinct_actions_across_episodes"),
        F.count_if("adjacent_change").alias("valid_adjacent_change_rows"),
        F.count_if("timestamp_tie").alias("timestamp_tie_rows"),
    )


def recorded_action_summary(flagged: DataFrame) -> DataFrame:
    per = flagged.groupBy("episode_id", "slice_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("action").alias("k"),
        F.count_if("adjacent_change").alias("c"),
        F.count_if("timestamp_tie").alias("t"),
    )
    return per.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("episodes_by_slice"),
        F.count_if(F.col("k") > 1).alias("episodes_with_multiple_recorded_actions"),
        F.sum("c").alias("adjacent_observed_action_changes"),
        F.sum("t").alias("timestamp_tie_rows"),
    )


def routing_check(evidence: DataFrame, source: DataFrame, split: str, key: str) -> DataFrame:
    """Every source row must be present in the evidence exactly once, per split."""
    seen = evidence.groupBy(split, key).agg(F.count(F.lit(1)).alias("n"))
    joined = source.select(split, key).join(seen, [split, key], "left")
    return joined.groupBy(split).agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("evidence_rows"),
        F.count_if(F.col("n").isNull()).alias("missing"),
        F.count_if(F.col("n") > 1).alias("repeated"),
    ).withColumn("exactly_once", (F.col("missing") == 0) & (F.col("repeated") == 0))
