"""Row-level expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient as double; NULL for a zero or missing denominator."""
    top = F.col(numerator) if isinstance(numerator, str) else numerator
    bottom = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def indicator(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not, NULL where unknown."""
    return F.when(condition, 1).when(~condition, 0)


def flag_on(name: str) -> Column:
    return F.col(name) == 1


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions)


def literal_map(key: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    """Look a fixed, short mapping up inside the projection, without a join."""
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    found = F.create_map(*pairs)[key]
    return found if default is None else F.coalesce(found, F.lit(default))
