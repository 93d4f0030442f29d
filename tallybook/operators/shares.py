"""Shares of a grand total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions import ratio


def share_of_total(df: DataFrame, shares: dict[str, str]) -> DataFrame:
    """Add ``shares[name] / sum(shares[name])`` for every requested name.

    The totals are one scalar subquery over the same aggregate. It asks for all
    totals at once, so it needs the same columns as ``df`` and Spark reuses the
    shuffle below it instead of scanning again.
    """
    totals = df.agg(F.struct(*[F.sum(c).alias(c) for c in set(shares.values())])).scalar()
    for name, column in shares.items():
        df = df.withColumn(name, ratio(F.col(column), totals[column]))
    return df
