"""Ordered look-back and look-ahead that stays parallel inside one hot key.

A plain `lag` or `lead` sends every row of a key to one task. Here a key is cut into buckets
of its order column: windows run per (key, bucket), and a small table with the edge rows of
every bucket carries values across bucket borders. The carry table has one row per non-empty
bucket, so a key that holds a third of all rows is still worked on by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"


def time_bucket(order_col: str, width: float) -> Column:
    return F.floor(F.col(order_col) / F.lit(float(width))).cast("long")


def _ordering(order: list[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def _edge_key(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def previous_value(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    value: Column,
    name: str,
    *,
    following: bool = False,
) -> DataFrame:
    """Latest non-null `value` strictly before each row (or first one after it).

    `order` must be a total order inside the key and monotone in `bucket`.
    """
    pick = F.min_by if following else F.max_by
    base = df.withColumn(BUCKET, bucket).withColumn("__value", value)
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*_ordering(order, following))
    local = F.last("__value", ignorenulls=True).over(
        inside.rowsBetween(Window.unboundedPreceding, -1)
    )
    # rows without a value have a null sort key, which min_by / max_by skip; no filter on the
    # value, which the optimizer would push below (and copy into) whatever computes it
    edges = base.groupBy(*keys, BUCKET).agg(
        pick("__value", F.when(F.col("__value").isNotNull(), _edge_key(order))).alias("__edge")
    )
    across = Window.partitionBy(*keys).orderBy(*_ordering([BUCKET], following))
    carry = edges.select(
        *keys,
        BUCKET,
        F.last("__edge", ignorenulls=True)
        .over(across.rowsBetween(Window.unboundedPreceding, -1))
        .alias("__carry"),
    )
    return (
        base.withColumn("__local", local)
        .join(carry, [*keys, BUCKET], "left")
        .withColumn(name, F.coalesce("__local", "__carry"))
        .drop(BUCKET, "__value", "__local", "__carry")
    )


def previous_values(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    value: Column,
    n: int,
    name: str,
    *,
    following: bool = False,
    include_current: bool = False,
) -> DataFrame:
    """Array with the up to `n` values before each row, nearest last.

    With `following` the values after the row, nearest first. With `include_current` the
    row's own value takes the nearest place and counts towards `n`.
    """
    reach = n - 1 if include_current else n
    base = df.withColumn(BUCKET, bucket).withColumn("__value", value)
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*_ordering(order, following))
    local = F.collect_list("__value").over(inside.rowsBetween(-reach, -1))
    backwards = Window.partitionBy(*keys, BUCKET).orderBy(*_ordering(order, not following))
    tails = (
        base.withColumn("__rank", F.row_number().over(backwards))
        .filter(F.col("__rank") <= reach)
        .groupBy(*keys, BUCKET)
        .agg(F.collect_list(F.struct((-F.col("__rank")).alias("r"), "__value")).alias("__t"))
        .withColumn("__tail", F.transform(F.sort_array("__t"), lambda t: t["__value"]))
    )
    across = Window.partitionBy(*keys).orderBy(*_ordering([BUCKET], following))
    carry = tails.select(
        *keys,
        BUCKET,
        F.flatten(F.collect_list("__tail").over(across.rowsBetween(-reach, -1))).alias("__carry"),
    )
    joined = (
        base.withColumn("__local", local)
        .join(carry, [*keys, BUCKET], "left")
        .withColumn("__all", F.concat(F.coalesce("__carry", F.slice("__local", 1, 0)), "__local"))
    )
    kept = F.slice("__all", F.greatest(F.size("__all") - (reach - 1), F.lit(1)), reach)
    if include_current:
        kept = F.concat(kept, F.array("__value"))
    if following:
        kept = F.reverse(kept)
    return joined.withColumn(name, kept).drop(BUCKET, "__value", "__local", "__carry", "__all")
