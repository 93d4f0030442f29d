"""Column expressions with the ledger's NULL and division rules."""

from tallybook.functions.aggregates import (
    cond_sum,
    count_if,
    distinct_with_null,
    null_if_zero,
    strict_sum,
    total,
)
from tallybook.functions.columns import all_of, flag_on, indicator, literal_map, ratio

__all__ = [
    "all_of",
    "cond_sum",
    "count_if",
    "distinct_with_null",
    "flag_on",
    "indicator",
    "literal_map",
    "null_if_zero",
    "ratio",
    "strict_sum",
    "total",
]
