"""Resampling inference on independent units: bootstrap intervals and sign permutation.

Draws are pure functions of (seed, replicate, unit), so results do not depend on partitioning
and can be recomputed after the loss of an executor. Replicates are a distributed range; the
table of units is joined by index, broadcast only while its checked size allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.functions.core import uniform
from policylake.functions.dims import constant, freeze
from policylake.operators.order_stats import hashed_index


def indexed_units(diffs: DataFrame) -> tuple[DataFrame, int]:
    """Units with a gap-free index, and their number."""
    units = freeze(hashed_index(diffs.select("unit", F.col("delta").cast("double")), "unit"))
    return units, units.count()


def bootstrap_interval(units: DataFrame, n: int, samples: int, seed: str) -> DataFrame:
    """2.5 % and 97.5 % quantile of resampled means."""
    spark = units.sparkSession
    draws = spark.range(samples * n).select(
        F.floor(F.col("id") / n).cast("long").alias("b"), (F.col("id") % n).alias("i")
    )
    pick = F.floor(uniform(seed, F.lit("boot"), F.col("b"), F.col("i")) * n).cast("long")
    means = draws.withColumn("idx", pick).join(units, "idx").groupBy("b").agg(F.avg("delta").alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.agg(q.alias("q")).select(F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def sign_permutation(units: DataFrame, n: int, samples: int, seed: str, slack: float = 1e-12) -> DataFrame:
    """Monte-Carlo two-sided p-value under random signs."""
    spark = units.sparkSession
    observed = units.agg(F.avg("delta").alias("o"))
    grid = spark.range(samples * n).select(
        F.floor(F.col("id") / n).cast("long").alias("p"), (F.col("id") % n).alias("idx")
    )
    sign = F.when(uniform(seed, F.lit("sign"), F.col("p"), F.col("idx")) < 0.5, -1.0).otherwise(1.0)
    null = grid.join(units, "idx").groupBy("p").agg(F.avg(sign * F.col("delta")).alias("m"))
    hits = F.count_if(F.abs("m") >= F.abs(observed.scalar()) - slack)
    return null.agg(((hits + 1) / (samples + 1)).alias("p_value"), F.lit(samples).cast("long").alias("permutations"))


def exact_permutation(units: DataFrame, n: int, slack: float = 1e-12) -> DataFrame:
    """Two-sided p-value over all 2^n sign patterns."""
    spark = units.sparkSession
    observed = units.agg(F.avg("delta").alias("o"))
    deltas = units.agg(F.sort_array(F.collect_list(F.struct("idx", "delta"))).alias("d"))  # n <= 18
    masks = spark.range(1 << n).withColumn("d", deltas.scalar())

    def signed(x: Column) -> Column:
        bit = F.col("id").bitwiseAND(F.pow(F.lit(2.0), x["idx"]).cast("long")) > 0
        return F.when(bit, x["delta"]).otherwise(-x["delta"])

    mean = F.aggregate(F.transform("d", signed), F.lit(0.0), lambda a, x: a + x) / n
    return masks.agg(
        (F.count_if(F.abs(mean) >= F.abs(observed.scalar()) - slack) / float(1 << n)).alias("p_value"),
        F.lit(1 << n).cast("long").alias("permutations"),
    )


def paired_inference(
    diffs: DataFrame, *, samples: int, permutations: int, seed: str, exact_limit: int = 18
) -> DataFrame:
    """One row: units, mean, interval, p-value, effect size and win rate of paired differences."""
    units, n = indexed_units(diffs)
    if n < 2:
        raise ValueError("need at least two paired units")
    exact = n <= exact_limit
    p = exact_permutation(units, n) if exact else sign_permutation(units, n, permutations, seed)
    sd = F.stddev_samp("delta")
    base = units.agg(
        F.count(F.lit(1)).alias("units"), F.avg("delta").alias("mean_delta"),
        F.when(sd > 1e-12, F.avg("delta") / sd).otherwise(0.0).alias("cohens_dz"),
        F.avg(F.when(F.col("delta") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
    )
    ci = bootstrap_interval(units, n, samples, seed)
    row = ci.first(), p.first()  # two numbers each
    return base.select(
        "*", F.lit(row[0]["ci_low"]).alias("ci_low"), F.lit(row[0]["ci_high"]).alias("ci_high"),
        F.lit(row[1]["p_value"]).alias("p_value"), F.lit(row[1]["permutations"]).alias("permutations"),
        F.lit("exact" if exact else "monte_carlo").alias("method"),
    )


def holm(df: DataFrame, p: str, name: str) -> DataFrame:
    """Holm step-down adjustment over the comparisons of one study (a handful of rows)."""
    from pyspark.sql import Window

    small = freeze(df, 4096)
    w = Window.orderBy(p, name)
    m = small.agg(F.count(F.lit(1)).alias("m"))
    ranked = small.withColumn("__r", F.row_number().over(w)).withColumn("__m", m.scalar())
    raw = (F.col("__m") - F.col("__r") + 1) * F.col(p)
    running = F.max(raw).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("holm_p", F.least(F.lit(1.0), running)).drop("__r", "__m")


ESTIMANDS = {
    "fixed_penalty": ("rows", "penalized_sum - reference_sum"),
    "hold_incumbent_dm": ("hold_pair_count", "hold_pair_difference_sum"),
    "observed_logged_hold_proxy": ("observed_pair_count", "observed_pair_difference_sum"),
}


def cluster_inference(clusters: DataFrame, estimand: str, **options) -> DataFrame:
    """Paired inference of one abstention estimand over experiment clusters, with coverage."""
    denominator, numerator = ESTIMANDS[estimand]
    d = clusters.filter(F.col(denominator) > 0).select(
        F.concat_ws("/", "scenario", "training_config", "experiment").alias("unit"),
        (F.expr(numerator) / F.col(denominator)).alias("delta"),
    )
    coverage = clusters.agg((F.sum(denominator) / F.greatest(F.sum("rows"), F.lit(1))).alias("c"))
    return paired_inference(d, exact_limit=16, **options).select(
        F.lit(estimand).alias("estimand"), "*", coverage.scalar().alias("paired_row_coverage")
    )


def aligned_clusters(candidate: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two policies' cluster tables that must match on every cluster and row count."""
    a = candidate.select(*keys, F.col("rows").alias("a_rows"), F.col("accepted").alias("a_accepted"), F.col("penalized_sum").alias("a_sum"))
    b = reference.select(*keys, F.col("rows").alias("b_rows"), F.col("accepted").alias("b_accepted"), F.col("penalized_sum").alias("b_sum"))
    joined = a.join(b, keys, "full")
    bad = F.col("a_rows").isNull() | F.col("b_rows").isNull() | (F.col("a_rows") != F.col("b_rows"))
    return joined.withColumn(
        "a_rows",
        F.when(bad, F.raise_error(F.lit("policies do not cover the same clusters and rows")).cast("long")).otherwise(F.col("a_rows")),
    )


def rank_metrics(scores: DataFrame, groups: list[str]) -> DataFrame:
    """AUROC, average precision and FPR at 95 % TPR from counts per distinct score.

    `scores` has (groups, score, positive). Work after the first aggregate is on distinct
    scores, ranked in bins rather than in one sorted task.
    """
    from policylake.operators.order_stats import running_totals

    counts = scores.groupBy(*groups, "score").agg(
        F.count_if("positive").alias("tp"), F.count_if(~F.col("positive")).alias("fp")
    )
    run = running_totals(counts, "score", ["tp", "fp"], groups=tuple(groups), descending=True)
    totals = counts.groupBy(*groups).agg(F.sum("tp").alias("P"), F.sum("fp").alias("N"))
    run = run.join(totals, groups) if groups else run.withColumns(
        {"P": totals.select("P").scalar(), "N": totals.select("N").scalar()}
    )
    area = F.sum(F.col("fp") * (F.col("tp_upto") - F.col("tp") + F.col("tp") / 2.0))
    ap = F.sum(F.col("tp") * (F.col("tp_upto") / (F.col("tp_upto") + F.col("fp_upto"))))
    fpr = F.min(F.when(F.col("tp_upto") / F.col("P") >= 0.95, F.col("fp_upto") / F.col("N")))
    return run.groupBy(*groups).agg(
        (area / (F.first("P") * F.first("N"))).alias("auroc"), (ap / F.first("P")).alias("auprc"),
        fpr.alias("fpr_at_95_tpr"),
    )


def conformal_p(calibration: DataFrame, queries: DataFrame, groups: list[str], score: str) -> DataFrame:
    """(#calibration >= score + 1) / (n + 1) per query row, by one ranked union per stratum.

    Both sides are first reduced to distinct scores, so a hot stratum is one running total
    over distinct values in bins.
    """
    from policylake.operators.order_stats import running_totals

    both = (
        calibration.select(*groups, F.col(score).alias("s"), F.lit(1).alias("c"))
        .unionByName(queries.select(*groups, F.col(score).alias("s"), F.lit(0).alias("c")))
        .groupBy(*groups, "s").agg(F.sum("c").alias("c"))
    )
    run = running_totals(both, "s", ["c"], groups=tuple(groups), descending=True)
    sizes = calibration.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_cal"))
    return (
        queries.join(run.select(*groups, F.col("s").alias(score), "c_upto"), [*groups, score])
        .join(sizes, groups, "left")
        .withColumn("p", F.coalesce((F.col("c_upto") + 1) / (F.col("n_cal") + 1), F.lit(0.0)))
    )
