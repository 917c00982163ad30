"""Small column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from policylake.constants import SCHEDULERS, SLICES


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, low: float | None, high: float | None) -> Column:
    out = col(c)
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return out


def finite(c: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite_or_null(c: Column | str) -> Column:
    return F.when(finite(c), col(c))


def ratio(n: Column | str, d: Column | str) -> Column:
    """n / d, null instead of an error when d is zero."""
    return F.try_divide(col(n).cast("double"), col(d).cast("double"))


def rounded(c: Column | str, digits: int = 9) -> Column:
    return F.round(col(c), digits)


def cond_rate(c: Column) -> Column:
    """Share of rows for which the condition holds."""
    return F.avg(F.when(c, 1.0).otherwise(0.0))


def decision_list(cases: list[tuple[Column, object]], default: object) -> Column:
    """First matching case wins."""
    head, *tail = [(c, v if isinstance(v, Column) else F.lit(v)) for c, v in cases]
    out = F.when(*head)
    for c, v in tail:
        out = out.when(c, v)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def lookup(c: Column | str, table: dict, default: object = None) -> Column:
    """Constant table lookup as a CASE expression."""
    c = col(c)
    return decision_list([(c == F.lit(k), v) for k, v in table.items()], default)


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Array of the texts whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in pairs]))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def slice_name(code: Column | str) -> Column:
    return lookup(F.rint(col(code)).cast("int"), SLICES)


def scheduler_name(code: Column | str) -> Column:
    n = F.rint(col(code)).cast("long")
    return lookup(n, SCHEDULERS, F.concat(F.lit("scheduler_"), n.cast("string")))


def action_label(scheduler_code: Column | str, slice_prb: Column | str) -> Column:
    """`<scheduler>:prb=<n>`; both numbers are rounded half-even."""
    return F.concat(
        scheduler_name(scheduler_code), F.lit(":prb="),
        F.rint(col(slice_prb)).cast("long").cast("string"),
    )


def action_prb(action: Column | str) -> Column:
    return F.regexp_extract(col(action), r":prb=(\d+)$", 1).cast("long")


def action_scheduler(action: Column | str) -> Column:
    return F.regexp_extract(col(action), r"^(.*):prb=\d+$", 1)


def uniform(*key: Column | str) -> Column:
    """Portable uniform in (0, 1): a pure function of the key, equal on every engine.

    The first 13 hex digits of md5(key) are read as an integer of 52 bits.
    """
    parts = [F.lit(k) if isinstance(k, str) else k.cast("string") for k in key]
    digest = F.md5(F.concat_ws("|", *parts))
    n = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (n + 0.5) / float(2**52)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once; a lambda computes what it captures for every element."""
    return F.transform(F.array(value), body)[0]


def first_of(array: Column) -> Column:
    """First element, null for an empty array (also under ANSI rules)."""
    return F.get(array, F.lit(0))
