"""First, last and n-th rows of an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.operators.rank import SortKey, sort_columns


def head(df: DataFrame, keys: list[SortKey], n: int) -> DataFrame:
    """First ``n`` rows; every task keeps only its own first ``n``."""
    return df.orderBy(*sort_columns(keys)).limit(n)


def tail(df: DataFrame, rank: str, n: int) -> DataFrame:
    """Last ``n`` rows of a ranked frame."""
    return df.orderBy(F.col(rank).desc()).limit(n)


def head_and_tail(df: DataFrame, rank: str, first: int, last: int) -> DataFrame:
    """First and last rows of a ranked frame, labelled; a row may be in both."""
    top = df.orderBy(F.col(rank).asc()).limit(first).withColumn("End", F.lit("head"))
    bottom = tail(df, rank, last).withColumn("End", F.lit("tail"))
    return top.unionByName(bottom)


def nth_rows(df: DataFrame, by: list[str], keys: list[SortKey], ranks: list[int]) -> DataFrame:
    """Rows at the given (small) positions of an order, per group.

    The bound on the position is a filter on the window's own number, which
    Spark turns into a limit per group and task before the shuffle. A large
    group never comes together.
    """
    position = F.row_number().over(Window.partitionBy(*by).orderBy(*sort_columns(keys)))
    placed = df.withColumn("_position", position).filter(F.col("_position") <= max(ranks))
    return placed.filter(F.col("_position").isin(ranks)).withColumn(
        "_position", F.col("_position").cast("long")
    )
