"""Appending a total row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def total_row(
    df: DataFrame, key: str, measures: list[str], label: str = "Total", extra_keys: tuple[str, ...] = ()
) -> DataFrame:
    """Sums per ``key`` plus one row of sums over all keys, in one aggregation.

    With ``extra_keys`` there is one total per combination of those. A column
    ``IsTotal`` tells a total from a key that happens to be NULL.
    """
    detail = [F.col(k) for k in (*extra_keys, key)]
    outer = [F.col(k) for k in extra_keys]
    sums = [F.sum(f"`{m}`").alias(m) for m in measures]
    totalled = df.groupingSets([detail, outer], *detail).agg(
        F.grouping(key).cast("int").alias("IsTotal"), *sums
    )
    return totalled.withColumn(key, F.when(F.col("IsTotal") == 1, label).otherwise(F.col(key)))
