"""Exact order statistics and ranks without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylake.operators.quantiles import quantiles

def exact_quantiles(df: DataFrame, value: str, probs: list[float]) -> list[float] | None:
    """Linear-interpolated quantiles of one column, as a handful of driver numbers."""
    row = quantiles(df, [], {value: probs}).first()
    return None if row is None else [row[f"{value}_{i}"] for i in range(len(probs))]


def positions(
    df: DataFrame,
    groups: list[str],
    buckets: list[str],
    order: list[str],
    name: str = "pos",
    size: str | None = None,
) -> DataFrame:
    """0-based position of each row inside its group, in the order (buckets, order).

    Rows are numbered per (group, bucket); bucket counts give the offsets. Only the table of
    bucket counts is ordered per group, so one hot group is still numbered by many tasks.
    """
    keys = [*groups, *buckets]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"))
    part = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = part.orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"),
        F.sum("__c").over(part).alias("__n"),
    )
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    out = df.withColumn("__r", local).join(offsets, keys)
    out = out.withColumn(name, (F.col("__r") + F.col("__o")).cast("long"))
    if size:
        out = out.withColumn(size, F.col("__n"))
    return out.drop("__r", "__o", "__n")


def hashed_index(df: DataFrame, unit: str, name: str = "idx") -> DataFrame:
    """Gap-free index 0..n-1 in the order of md5(unit), numbered in 256 independent buckets."""
    keyed = df.withColumn("__h", F.md5(F.col(unit).cast("string"))).withColumn(
        "__p", F.substring("__h", 1, 2)
    )
    return positions(keyed, [], ["__p"], ["__h"], name).drop("__h", "__p")


def running_totals(
    df: DataFrame,
    value: str,
    amounts: list[str],
    bins: int = 256,
    groups: tuple[str, ...] = (),
    descending: bool = True,
) -> DataFrame:
    """Cumulative sums of `amounts` over distinct values of `value` in order.

    `df` holds one row per (group, value). Rows are binned between approximate quantiles, a
    window runs per bin, and bin totals give the offsets; adds `<amount>_upto` columns.
    """
    bounds = df.agg(
        F.percentile_approx(value, [i / bins for i in range(1, bins)], 10_000).alias("b")
    )
    keyed = df.withColumn("__bounds", bounds.scalar())
    keyed = keyed.withColumn(
        "__bin", F.size(F.filter("__bounds", lambda b: b < F.col(value))).cast("long")
    ).drop("__bounds")
    arrange: Column = F.col(value).desc() if descending else F.col(value).asc()
    outer: Column = F.col("__bin").desc() if descending else F.col("__bin").asc()
    totals = keyed.groupBy(*groups, "__bin").agg(*[F.sum(a).alias(f"__t_{a}") for a in amounts])
    across = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    across = across.orderBy(outer).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups,
        "__bin",
        *[F.coalesce(F.sum(f"__t_{a}").over(across), F.lit(0)).alias(f"__o_{a}") for a in amounts],
    )
    inside = (
        Window.partitionBy(*groups, "__bin")
        .orderBy(arrange)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    out = keyed
    for a in amounts:
        out = out.withColumn(f"__w_{a}", F.sum(a).over(inside))
    out = out.join(offsets, [*groups, "__bin"])
    for a in amounts:
        out = out.withColumn(f"{a}_upto", F.col(f"__w_{a}") + F.col(f"__o_{a}"))
    return out.drop("__bin", *[f"__w_{a}" for a in amounts], *[f"__o_{a}" for a in amounts])
