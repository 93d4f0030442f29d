"""Reusable DataFrame operators behind the named computations."""

from tallybook.operators.bands import flag_ranks, rank_bands
from tallybook.operators.categories import map_categories
from tallybook.operators.crosstab import add_shares, pivot_with_total
from tallybook.operators.geography import incomplete_successors, rollup_geography
from tallybook.operators.joins import (
    attach,
    exclude,
    keys_present,
    match_suppliers,
    restrict_to_list,
    unique_key,
)
from tallybook.operators.rank import (
    SortKey,
    ascending,
    descending,
    global_rank,
    range_rank,
    sort_columns,
)
from tallybook.operators.recode import recode
from tallybook.operators.shares import share_of_total
from tallybook.operators.slices import head, head_and_tail, nth_rows, tail
from tallybook.operators.totals import total_row
from tallybook.operators.twolevel import group_with_attribute, two_level

__all__ = [
    "SortKey",
    "add_shares",
    "ascending",
    "attach",
    "descending",
    "exclude",
    "flag_ranks",
    "global_rank",
    "group_with_attribute",
    "head",
    "head_and_tail",
    "incomplete_successors",
    "keys_present",
    "map_categories",
    "match_suppliers",
    "nth_rows",
    "pivot_with_total",
    "range_rank",
    "rank_bands",
    "recode",
    "restrict_to_list",
    "rollup_geography",
    "share_of_total",
    "sort_columns",
    "tail",
    "total_row",
    "two_level",
    "unique_key",
]
