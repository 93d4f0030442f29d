"""Bands and marks on a rank."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_bands(
    df: DataFrame, rank: str, name: str, bands: int = 4, cuts: list[float] | None = None
) -> DataFrame:
    """Number the bands of a rank from 1.

    With ``cuts`` a row's band is one more than the cuts below its rank;
    without, the n ranks are cut at n/bands, 2n/bands and so on.
    """
    if cuts is not None:
        above = reduce(add, [(F.col(rank) > F.lit(cut)).cast("long") for cut in cuts])
        return df.withColumn(name, above + 1)
    rows = F.count(F.lit(1)).over(Window.partitionBy())
    band = F.ceil(F.col(rank) * bands / rows)
    return df.withColumn(name, band.cast("long"))


def flag_ranks(
    df: DataFrame, rank: str, ranks: list[int], name: str, marked: str = "CaseStudy", other: str = "Other"
) -> DataFrame:
    """Label the rows at the given ranks."""
    return df.withColumn(name, F.when(F.col(rank).isin(ranks), marked).otherwise(other))
