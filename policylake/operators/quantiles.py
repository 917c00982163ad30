"""Exact quantiles of many columns and groups by narrowing on the ordered bits of doubles.

A double maps to a long of the same order. Each round counts, for every group and column at once, the
values below each open prefix by their next 16 bits, and moves every wanted rank into the digit that
holds it; a rank whose digit holds one value only is settled. So there are four rounds at most, each
one aggregate with map-side sums over a narrow table, and no task sorts or ranks the values.

Nulls and NaN are left out; infinities are the largest and smallest values. A group without
values has no row. Group columns must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylake.sources.sinks import staged

_TOP = 1 << 52
_INFINITE = 2047 * _TOP


def ordered(value: Column) -> Column:
    """The IEEE bits of a double as a long that sorts like the double; null for NaN."""
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    first = size * F.pow(F.lit(2.0), -guess)
    exponent = guess + F.when(first >= 2.0, F.lit(1)).when(first < 1.0, F.lit(-1)).otherwise(F.lit(0))
    fraction = (size * F.pow(F.lit(2.0), -exponent) - 1.0) * float(_TOP)
    small = size * F.lit(2.0**537) * F.lit(2.0**537)  # below the least normal number
    bits = (
        F.when(size == float("inf"), F.lit(_INFINITE))
        .when(size < 2.0**-1022, small.cast("long"))
        .otherwise((exponent + 1023) * F.lit(_TOP) + fraction.cast("long"))
    )
    return F.when(F.isnan(value), F.lit(None)).when(value < 0, -bits).otherwise(bits).cast("long")


def value_of(bits: Column) -> Column:
    """The double with these ordered bits."""
    size = F.abs(bits)
    exponent, fraction = F.shiftright(size, 52), size.bitwiseAND(F.lit(_TOP - 1)).cast("double")
    value = (
        F.when(exponent == 2047, F.lit(float("inf")))
        .when(exponent == 0, fraction * F.lit(2.0**-1074))
        .otherwise((fraction / float(_TOP) + 1.0) * F.pow(F.lit(2.0), exponent - 1023))
    )
    return F.when(bits < 0, -value).otherwise(value)


def _targets(probs: list[list[float]]) -> Column:
    """(which, rank) of the two values around each wanted quantile of a column with `n` values."""
    each = []
    for i, ps in enumerate(probs):
        ranks = []
        for j, p in enumerate(ps):
            at = (F.col("n") - 1) * F.lit(float(p))
            ranks += [F.struct(F.lit(2 * j).alias("which"), F.floor(at).alias("rank")), F.struct(F.lit(2 * j + 1).alias("which"), F.ceil(at).alias("rank"))]
        each.append(F.when(F.col("column") == i, F.array(*ranks)))
    return F.coalesce(*each)


def quantiles(df: DataFrame, groups: list[str], wanted: dict[str, list[float]], weight: str | None = None) -> DataFrame:
    """One row per group: `<column>_n` and, for the i-th probability, `<column>_<i>` (linear interpolation).

    `weight` names a column of whole numbers: how often the row's values count.
    """
    columns, probs = list(wanted), list(wanted.values())
    cells = F.array(*[F.struct(F.lit(i).alias("column"), ordered(F.col(c).cast("double")).alias("bits")) for i, c in enumerate(columns)])
    times = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    names = [f"__g{i}" for i in range(len(groups))]
    data = df.select(*[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)], times.alias("w"), F.inline(cells))
    data = staged(data.where("bits IS NOT NULL AND w > 0"), "quantiles")

    state = None
    for shift in (48, 32, 16, 0):
        keys = [*names, "column"]
        if state is None:
            rows = data.withColumn("prefix", F.lit(0).cast("long"))
        else:
            undecided = state.where("low < high")
            if not undecided.limit(1).count():
                break
            rows = data.withColumn("prefix", F.shiftright("bits", shift + 16)).join(undecided.select(*keys, "prefix").distinct(), [*keys, "prefix"], "left_semi")
        digits = rows.groupBy(*keys, "prefix", F.shiftright("bits", shift).alias("digit")).agg(
            F.sum("w").alias("c"), F.min("bits").alias("low"), F.max("bits").alias("high")
        )
        part = Window.partitionBy(*keys, "prefix")
        upto = F.sum("c").over(part.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        digits = digits.select(*keys, "prefix", "digit", "low", "high", (upto - F.col("c")).alias("below"), upto.alias("upto"), F.sum("c").over(part).alias("n"))
        if state is None:
            inside = F.filter(_targets(probs), lambda t: (t["rank"] >= F.col("below")) & (t["rank"] < F.col("upto")))
            found = digits.select(*keys, "digit", "low", "high", "below", "n", F.inline(inside))
        else:
            open_ = undecided.select(*keys, "prefix", "which", "rank", F.col("n").alias("all"))
            found = digits.drop("n").join(open_, [*keys, "prefix"]).where("rank >= below AND rank < upto").withColumnRenamed("all", "n")
        moved = found.select(*keys, "which", F.col("digit").alias("prefix"), (F.col("rank") - F.col("below")).alias("rank"), "low", "high", "n")
        state = staged(moved if state is None else moved.unionByName(state.where("low = high")), "quantiles")

    out = []
    for i, c in enumerate(columns):
        mine = F.col("column") == i
        out.append(F.max(F.when(mine, F.col("n"))).alias(f"{c}_n"))
        for j, p in enumerate(probs[i]):
            a, b = (F.max(F.when(mine & (F.col("which") == 2 * j + k), F.col("value"))) for k in (0, 1))
            at = (F.max(F.when(mine, F.col("n"))) - 1) * F.lit(float(p))
            out.append((a + F.when(b > a, (b - a) * (at - F.floor(at))).otherwise(0.0)).alias(f"{c}_{j}"))
    values = state.withColumn("value", value_of(F.col("low")))
    return values.groupBy(*[F.col(n).alias(g) for g, n in zip(groups, names, strict=True)]).agg(*out)
