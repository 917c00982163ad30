"""Grouped aggregates: counts, summaries, metrics, calibration, accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylake.constants import CLUSTER_COLUMNS
from policylake.functions.core import finite


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of each value of several columns in one pass."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return df.select(F.inline(pairs)).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def long_metrics(df: DataFrame, groups: list[str], metrics: list[str]) -> DataFrame:
    """One row per (group, metric, value)."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    )
    return df.select(*groups, F.inline(pairs))


def summary_stats(df: DataFrame, groups: list[str], metrics: list[str]) -> DataFrame:
    """n, mean, std, half width of the 95 % interval, min and max per metric and group."""
    values = long_metrics(df, groups, metrics).filter(F.col("value").isNotNull())
    n = F.count(F.lit(1))
    std = F.when(n > 1, F.stddev_samp("value")).otherwise(0.0)
    return values.groupBy(*groups, "metric").agg(
        n.alias("n"),
        F.avg("value").alias("mean"),
        std.alias("std"),
        F.when(n > 1, 1.96 * std / F.sqrt(n)).otherwise(0.0).alias("ci95_half_width"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def weighted_average(value: Column, weight: Column) -> Column:
    """Weighted mean over finite values with positive weight."""
    ok = finite(value) & finite(weight) & (weight > 0)
    return F.sum(F.when(ok, value * weight)) / F.sum(F.when(ok, weight))


def fold_merge(df: DataFrame, metrics: list[str], weights: dict[str, str], default: str) -> DataFrame:
    """Merge per-fold rows of each (split, model) with metric-specific weights."""
    return df.groupBy("split", "model").agg(
        F.sum(default).alias("rows"),
        *[
            weighted_average(F.col(m).cast("double"), F.col(weights.get(m, default)).cast("double")).alias(m)
            for m in metrics
        ],
    )


def feature_drift(reference: DataFrame, current: DataFrame, features: list[str], groups: list[str] | None = None) -> DataFrame:
    """Per feature (and group of current rows) min(1, |shift of the mean| / (4 sigma of the reference))."""
    groups = groups or []
    ref = long_metrics(reference, [], features).groupBy("metric").agg(
        F.avg("value").alias("mu"), F.stddev_pop("value").alias("sigma")
    )
    cur = long_metrics(current, groups, features).groupBy(*groups, "metric").agg(F.avg("value").alias("now"))
    shift = F.abs(F.col("now") - F.col("mu")) / (4 * F.greatest(F.col("sigma"), F.lit(1e-6)))
    return ref.join(cur, "metric").select(*groups, "metric", F.least(F.lit(1.0), shift).alias("drift"))


def episode_calibration(
    df: DataFrame, residual: str, confidence: float, min_episodes: int, groups: list[str]
) -> DataFrame:
    """Upper residual margins from episode means and episode maxima.

    The quantile is the order statistic at ceil((n - 1) * level); with too few episodes the
    margin is infinite, so nothing can be accepted.
    """
    per = (
        df.filter(finite(residual))
        .groupBy(*groups, "episode_id")
        .agg(F.avg(residual).alias("m"), F.max(residual).alias("x"), F.count(F.lit(1)).alias("rows"))
    )
    sizes = per.groupBy(*groups).agg(F.count(F.lit(1)).alias("episodes"), F.sum("rows").alias("rows"))
    n = F.col("episodes").cast("double")
    level = F.least(F.lit(1.0), F.ceil((n + 1) * confidence) / n)
    sizes = sizes.withColumn("__k", F.ceil((n - 1) * level).cast("long"))

    def order_stat(value: str, name: str) -> DataFrame:
        counted = per.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("c"))
        w = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        ranked = counted.withColumn("__upto", F.sum("c").over(w)).join(
            sizes.select(*groups, "__k"), groups
        )
        return (
            ranked.filter(F.col("__upto") > F.col("__k"))
            .groupBy(*groups)
            .agg(F.min(value).alias(name))
        )

    needed = max(min_episodes, -(-int(round((1 / (1 - confidence) - 1) * 1e9)) // 10**9))
    enough = F.col("episodes") >= needed
    infinite = F.lit(float("inf"))
    return (
        sizes.join(order_stat("m", "__mean"), groups)
        .join(order_stat("x", "__worst"), groups)
        .select(
            *groups,
            "episodes",
            "rows",
            enough.alias("usable"),
            F.when(enough, F.greatest(F.col("__mean"), F.lit(0.0))).otherwise(infinite).alias("margin"),
            F.when(enough, F.greatest(F.col("__worst"), F.lit(0.0))).otherwise(infinite).alias("worst_margin"),
        )
    )


ACCOUNTING_SUMS = [
    "rows", "accepted", "abstained", "hold_supported_abstentions", "logged_incumbent_abstentions",
    "reference_sum", "penalized_sum", "hold_pair_count", "hold_pair_difference_sum",
    "observed_pair_count", "observed_pair_difference_sum", "accepted_utility_sum",
]


def cluster_accounting(
    df: DataFrame, penalty: float = -0.12, keys: list[str] | None = None
) -> DataFrame:
    """Additive sums per experiment cluster for the three abstention estimands.

    Needs columns accepted, selected_dm, reference_dm, incumbent_dm, incumbent_supported,
    logged_incumbent, logged_observed. All twelve sums combine map-side.
    """
    a, sel, ref = F.col("accepted"), F.col("selected_dm"), F.col("reference_dm")
    hold = ~a & F.col("incumbent_supported") & finite("incumbent_dm")
    logged = ~a & F.col("logged_incumbent") & finite("logged_observed")

    def total(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))

    return df.groupBy(*(keys or CLUSTER_COLUMNS)).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(a).alias("accepted"),
        F.count_if(~a).alias("abstained"),
        F.count_if(hold).alias("hold_supported_abstentions"),
        F.count_if(logged).alias("logged_incumbent_abstentions"),
        F.sum(ref).alias("reference_sum"),
        F.sum(F.when(a, sel).otherwise(penalty)).alias("penalized_sum"),
        F.count_if(a | hold).alias("hold_pair_count"),
        total(a | hold, F.when(a, sel).otherwise(F.col("incumbent_dm")) - ref).alias("hold_pair_difference_sum"),
        F.count_if(a | logged).alias("observed_pair_count"),
        total(a | logged, F.when(a, sel).otherwise(F.col("logged_observed")) - ref).alias("observed_pair_difference_sum"),
        total(a, sel).alias("accepted_utility_sum"),
    )


def combine_accounting(chunks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Final aggregate of partial accounting rows."""
    return chunks.groupBy(*(keys or CLUSTER_COLUMNS)).agg(*[F.sum(c).alias(c) for c in ACCOUNTING_SUMS])


def accounting_ratios(clusters: DataFrame) -> DataFrame:
    s = clusters.agg(*[F.sum(c).alias(c) for c in ACCOUNTING_SUMS])
    rows = F.greatest(F.col("rows"), F.lit(1)).cast("double")
    abstained = F.greatest(F.col("abstained"), F.lit(1)).cast("double")
    return s.select(
        "rows",
        (F.col("accepted") / rows).alias("actuation_coverage"),
        (1 - F.col("accepted") / rows).alias("abstention_rate"),
        (F.col("penalized_sum") / rows).alias("fixed_penalty_score"),
        (F.col("reference_sum") / rows).alias("reference_dm_mean"),
        F.try_divide(F.col("accepted_utility_sum"), F.col("accepted")).alias("accepted_action_dm_mean"),
        (F.col("hold_supported_abstentions") / abstained).alias("hold_incumbent_evaluator_support_rate"),
        (F.col("logged_incumbent_abstentions") / abstained).alias("observed_logged_incumbent_rate"),
    )


def confusion(df: DataFrame, label: str, predicted: str, groups: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(groups or []), F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_report(matrix: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 per class from a confusion table; zero where undefined."""
    g = groups or []
    sides = matrix.select(
        *g,
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("calls"),
                         F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits")),
                F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("calls"),
                         F.lit(0).cast("long").alias("hits")),
            )
        ),
    )
    t = sides.groupBy(*g, "class").agg(*[F.sum(c).alias(c) for c in ("support", "calls", "hits")])
    precision = F.coalesce(F.try_divide("hits", "calls"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("calls")), F.lit(0.0))
    return t.select(*g, "class", "support", "hits", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def classification_summary(report: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Accuracy and macro-F1 over the classes that occur as label or prediction."""
    return report.groupBy(*(groups or [])).agg(
        F.sum("support").alias("rows"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
    )


def regression_metrics(df: DataFrame, truth: str, predicted: str, groups: list[str] | None = None) -> DataFrame:
    """MAE, RMSE and R2 from sums that combine map-side."""
    y, e = F.col(truth), F.col(truth) - F.col(predicted)
    return df.groupBy(*(groups or [])).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / (F.var_pop(y) * F.count(F.lit(1)))).alias("r2"),
    )
