"""Re-aggregation to a coarser geography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import strict_sum
from tallybook.operators.joins import attach
from tallybook.operators.twolevel import group_with_attribute


def successor_columns(lookup: DataFrame) -> DataFrame:
    """Present code, successor code and successor name of every unit."""
    return lookup.select(F.col("CCGCode2018").alias("CCGCode"), "CCGCode2020", "CCGName2020")


def rollup_geography(
    df: DataFrame, lookup: DataFrame, key: str, sums: dict[str, Column]
) -> DataFrame:
    """Aggregate a per-body frame to its successor units.

    ``df`` is already one row per body, so only that frame meets the lookup.
    A unit keyed by its code also gets its name.
    """
    placed = attach(df, successor_columns(lookup), "CCGCode")
    if key == "CCGCode2020":
        return group_with_attribute(placed, key, "CCGName2020", sums, strict_sum)
    return placed.groupBy(key).agg(*[value.alias(name) for name, value in sums.items()])


def incomplete_successors(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Successor units of which at least one component is not in ``df``."""
    missing = successor_columns(lookup).join(df.select("CCGCode"), "CCGCode", "left_anti")
    return missing.select(key).distinct()
