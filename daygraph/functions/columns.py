"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pick(values: list, index: Column) -> Column:
    """``values[index]`` for a zero-based index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def r6(value: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(value.cast("double"), 6) + F.lit(0.0)


def ratio(top: Column, bottom: Column, empty: float | None = None) -> Column:
    """Division that never raises; an empty denominator gives ``empty``."""
    safe = F.try_divide(top.cast("double"), bottom.cast("double"))
    return safe if empty is None else F.coalesce(safe, F.lit(empty))


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def rows() -> Column:
    return F.count(F.lit(1)).cast("long")


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 from counts, zero when undefined."""
    return ratio(2 * tp, 2 * tp + fp + fn, 0.0)
