"""Mapping a closed domain to report categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions import literal_map


def map_categories(
    df: DataFrame, source: str, target: str, mapping: dict[str, str], other: str
) -> DataFrame:
    return df.withColumn(target, literal_map(F.col(source), mapping, other))


def display_order(df: DataFrame, column: str, order: list[str], name: str) -> DataFrame:
    """Add the 1-based place of ``column`` in a fixed display order."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return df.withColumn(name, place.cast("long"))
