"""Recoding a value that means different things at different bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recode(
    df: DataFrame, rules: list[tuple[list[str], list[str], str]], key: str, column: str
) -> DataFrame:
    """Apply the first rule ``(keys, old values, new value)`` that fits a row.

    A rule does not see the result of an earlier one; rules whose new values
    are old values of none, such as the shipped ones, give the same either way.
    An unknown key makes the condition of a rule unknown exactly where the old
    value occurs, and an unknown condition gives NULL: a row with a NULL key
    and a listed old value loses the value.
    """
    listed = sorted({old for _, olds, _ in rules for old in olds})
    value = F.when(F.col(key).isNull() & F.col(column).isin(listed), F.lit(None).cast("string"))
    for keys, olds, new in rules:
        value = value.when(F.col(key).isin(keys) & F.col(column).isin(olds), new)
    return df.withColumn(column, value.otherwise(F.col(column)))
