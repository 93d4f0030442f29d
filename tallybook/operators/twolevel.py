"""Aggregations in two steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_level(
    df: DataFrame, outer: list[str], inner: list[str], count_name: str, measures: list[str]
) -> DataFrame:
    """Number of ``inner`` groups and sums of ``measures`` per ``outer`` key.

    A NULL inner key is one group. Rows are combined before both shuffles, so
    the size of one group does not matter.
    """
    groups = df.groupBy(*outer, *inner).agg(*[F.sum(m).alias(m) for m in measures])
    return groups.groupBy(*outer).agg(
        F.count(F.lit(1)).alias(count_name), *[F.sum(m).alias(m) for m in measures]
    )


def group_with_attribute(
    df: DataFrame,
    key: str,
    attribute: str,
    measures: dict[str, Column],
    combine: Callable[[str], Column] = F.sum,
) -> DataFrame:
    """Measures per key with the one attribute value the key stands for.

    Taking the attribute by ``min`` in the first aggregation would make Spark
    sort every row, because text has no fixed-width aggregation buffer. Here
    the rows are hash-aggregated by key and attribute, and only those few
    groups are reduced to the key.
    """
    fine = df.groupBy(key, attribute).agg(*[c.alias(name) for name, c in measures.items()])
    return fine.groupBy(key).agg(
        F.min(attribute).alias(attribute), *[combine(name).alias(name) for name in measures]
    )
