"""Aggregate expressions. All of them combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strict_sum(value: Column | str) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    value = _col(value)
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def cond_sum(value: Column | str, condition: Column) -> Column:
    """Sum over the rows meeting ``condition``; 0 when there are none."""
    return F.coalesce(F.sum(F.when(condition, _col(value))), F.lit(0))


def total(value: Column | str) -> Column:
    """Sum over all rows; 0 when there are none."""
    return F.coalesce(F.sum(_col(value)), F.lit(0))


def count_if(condition: Column) -> Column:
    """Rows meeting ``condition``; an unknown condition does not count."""
    return F.count(F.when(condition, F.lit(1)))


def distinct_with_null(value: Column | str, where: Column | None = None) -> Column:
    """Distinct values, with NULL counted as one value of its own."""
    value = _col(value)
    missing = value.isNull()
    if where is not None:
        missing = where & missing
        value = F.when(where, value)
    return F.count_distinct(value) + F.max(F.when(missing, 1).otherwise(0)).cast("long")


def null_if_zero(value: Column) -> Column:
    return F.when(value != 0, value)
