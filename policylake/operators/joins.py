"""Join operators on small action dimensions and validated joins on row keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.functions.core import clip, decision_list
from policylake.functions.dims import freeze


def expand_candidates(rows: DataFrame, train: DataFrame) -> DataFrame:
    """One row per (row, action of the training catalogue).

    The catalogue is one sorted array, a scalar of the plan; rows are expanded in place
    without a shuffle. Filters on row columns belong before this step.
    """
    catalogue = train.agg(F.sort_array(F.collect_set("action")).alias("a"))
    return rows.withColumn("candidate", F.explode(catalogue.scalar()))


def support_flag(rows: DataFrame, seen: DataFrame, action: str) -> DataFrame:
    """Whether (slice, action) occurs in `seen`."""
    support = freeze(
        seen.select("slice_type", F.col("action").alias(action)).distinct().withColumn("__hit", F.lit(True))
    )
    out = rows.join(support, ["slice_type", action], "left")
    return out.withColumn("supported", F.coalesce("__hit", F.lit(False))).drop("__hit")


def keep_or_fallback(rows: DataFrame, action: str, support: DataFrame, fallback: DataFrame) -> DataFrame:
    """Keep a supported proposal, else take the slice's fallback."""
    known = support.select("slice_type", F.col("action").alias(action), F.col("action").alias("__kept"))
    out = rows.join(known, ["slice_type", action], "left").join(fallback, "slice_type")
    return out.withColumns(
        {"normalized_action": F.coalesce("__kept", "fallback"), "replaced": F.col("__kept").isNull()}
    ).drop("__kept")


def slice_mean(train: DataFrame, target: str) -> DataFrame:
    return train.groupBy("slice_type").agg(F.avg(target).alias("prediction"))


def mean_residual(train: DataFrame, target: str, predictions: DataFrame) -> DataFrame:
    """Mean residual per (slice, action) of a per-slice prediction."""
    return (
        train.join(predictions, "slice_type")
        .groupBy("slice_type", "action")
        .agg(F.avg(F.col(target) - F.col("prediction")).alias("correction"))
    )


def adapt(rows: DataFrame, prediction: str, corrections: DataFrame) -> DataFrame:
    out = rows.join(corrections, ["slice_type", "action"], "left")
    return out.withColumn("adapted", clip(F.col(prediction) + F.coalesce("correction", F.lit(0.0)), 0.0, 1.0))


def validated_many_to_one(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Left join that fails on duplicate right keys and on any left row without a match."""
    unique = right.groupBy(*keys).agg(F.first(value).alias(value), F.count(F.lit(1)).alias("__n"))
    checked = unique.withColumn(
        value,
        F.when(F.col("__n") == 1, F.col(value)).otherwise(F.raise_error(F.lit("duplicate right keys")).cast("string")),
    ).drop("__n")
    out = left.join(checked, keys, "left")
    return out.withColumn(
        value, F.coalesce(F.col(value), F.raise_error(F.lit("row without a match")).cast("string"))
    )


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two aggregates that fails if either side repeats a key."""
    def single(side: DataFrame, name: str) -> DataFrame:
        counted = side.groupBy(*keys).agg(F.count(F.lit(1)).alias(name), *[F.first(c).alias(c) for c in side.columns if c not in keys])
        return counted

    joined = single(left, "__l").join(single(right, "__r"), keys)
    repeated = (F.col("__l") > 1) | (F.col("__r") > 1)
    checked = F.when(repeated, F.raise_error(F.lit("a key occurs more than once")).cast("boolean")).otherwise(F.lit(True))
    return joined.withColumn("__ok", checked).where("__ok").drop("__ok", "__l", "__r")


def route_folds(rows: DataFrame, experiments: list[str]) -> DataFrame:
    """Role of every row in every fold; a test row is used only by its own experiment's fold."""
    folds = F.array(*[F.lit(e) for e in experiments])
    long = rows.withColumn("fold", F.explode(folds))
    mine = F.col("experiment") == F.col("fold")
    split = F.col("publication_split")
    role = decision_list(
        [
            ((split == "train") & mine, "policy_fit"),
            (split == "train", "evaluator_fit"),
            (split == "validation", "validation"),
            ((split == "test_seen") & mine, "seen"),
            ((split == "test_unseen") & mine, "unseen"),
        ],
        F.lit(None).cast("string"),
    )
    return long.withColumn("role", role).filter(F.col("role").isNotNull())


def support_coverage(
    policy: DataFrame, evaluator: DataFrame, cell: list[str], groups: list[str]
) -> DataFrame:
    """Cells of each role and of both, with the coverage of each role by the common cells."""
    keys = [*groups, *cell]
    roles = policy.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("e")).unionByName(
        evaluator.select(*keys, F.lit(0).alias("p"), F.lit(1).alias("e"))
    )
    seen = roles.groupBy(*keys).agg(F.max("p").alias("p"), F.max("e").alias("e"))
    out = seen.groupBy(*groups).agg(
        F.sum("p").alias("policy_cells"), F.sum("e").alias("evaluator_cells"),
        F.sum(F.col("p") * F.col("e")).alias("common_cells"),
    )
    return out.withColumns(
        {
            "policy_coverage": F.try_divide("common_cells", "policy_cells"),
            "evaluator_coverage": F.try_divide("common_cells", "evaluator_cells"),
        }
    )


def paired_group_means(
    left: DataFrame, right: DataFrame, left_value: str, right_value: str, keys: list[str]
) -> DataFrame:
    """Group means of two policies on the common groups."""
    a = left.groupBy(*keys).agg(F.avg(left_value).alias("left_mean"))
    b = right.groupBy(*keys).agg(F.avg(right_value).alias("right_mean"))
    return a.join(b, keys).withColumn("delta", F.col("left_mean") - F.col("right_mean"))
