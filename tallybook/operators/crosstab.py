"""Cross-tabulation over a closed domain."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import ratio


def pivot_with_total(
    df: DataFrame, key: str, column: str, values: list[str], measure: Column
) -> DataFrame:
    """One row per key, one column per value, missing cells 0, and their Total.

    The values are given, so no extra job looks for them. A value that is not
    among them fails the job: left out, it would be missing from the totals.
    """
    listed = F.coalesce(F.col(column).isin(values), F.lit(False))
    message = F.concat(F.lit(f"{column} has a value off its list: "), F.coalesce(F.col(column), F.lit("NULL")))
    df = df.filter(F.when(listed, True).otherwise(F.raise_error(message).cast("boolean")))
    wide = df.groupBy(key).pivot(column, values).agg(measure)
    cells = [F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(v) for v in values]
    filled = wide.select(key, *cells)
    return filled.withColumn("Total", reduce(add, [F.col(f"`{v}`") for v in values]))


def add_shares(df: DataFrame, names: dict[str, str], total: str = "Total") -> DataFrame:
    """Add ``column / total`` under the mapped name for every column."""
    return df.select(
        "*", *[ratio(F.col(f"`{column}`"), F.col(total)).alias(name) for column, name in names.items()]
    )
