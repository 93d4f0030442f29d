"""Spend split per body and everything derived from it.

One aggregation reads the ledger. What follows works on one row per body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions import cond_sum, flag_on, ratio, strict_sum
from tallybook.operators import (
    ascending,
    attach,
    descending,
    exclude,
    flag_ranks,
    global_rank,
    group_with_attribute,
    incomplete_successors,
    rank_bands,
    rollup_geography,
)

# Ranks marked as case studies, quartile cuts and excluded units.
CASE_STUDY_RANKS = [3, 36, 41, 46, 54, 73, 100, 116, 135, 151, 162, 182]
SUCCESSOR_CASE_STUDY_RANKS = [8, 29, 31, 91, 95, 111]
SUCCESSOR_CUTS = [32.5, 65.5, 97.5]
EXCLUDED_SUCCESSORS = ["E38000248", "E38000232", "E38000233"]


def spend_split_by_body(extract: DataFrame) -> DataFrame:
    """Public, VCSE and other spending per body with shares and a rank."""
    public = flag_on("NHS") | flag_on("LA")
    private = (F.col("NHS") == 0) & (F.col("LA") == 0)
    vcse = F.col("VCSE_Status")
    sums = {
        "TotalSpend": F.sum("Spending"),
        "NHSLASpend": cond_sum("Spending", public),
        "NonNHSLASpend": cond_sum("Spending", private),
        "NonNHSLAVCSESpend": cond_sum("Spending", private & (vcse == 1)),
        "NonNHSLANonVCSESpend": cond_sum("Spending", private & (vcse == 0)),
    }
    split = group_with_attribute(extract, "CCGName", "CCGCode", sums)
    shares = {
        "PC_NHSLASpend": ("NHSLASpend", "TotalSpend"),
        "PC_NonNHSLASpend": ("NonNHSLASpend", "TotalSpend"),
        "PC_NonNHSLAVCSESpend": ("NonNHSLAVCSESpend", "TotalSpend"),
        "PC_NonNHSLAVCSENonSpend": ("NonNHSLANonVCSESpend", "TotalSpend"),
        "VCSEofNonNHSLASpend": ("NonNHSLAVCSESpend", "NonNHSLASpend"),
        "NonVCSEofNonNHSLASpend": ("NonNHSLANonVCSESpend", "NonNHSLASpend"),
    }
    shared = split.withColumns({name: ratio(*parts) for name, parts in shares.items()})
    return global_rank(shared, [descending("PC_NonNHSLASpend"), ascending("CCGName")], "ID")


def _rerank(df: DataFrame, metric: str) -> DataFrame:
    """Rank by another metric; equal values keep the order of the rank before."""
    renamed = df.withColumnRenamed("ID", "_before")
    return global_rank(renamed, [descending(metric), ascending("_before")], "ID").drop("_before")


def stacked_shares(split: DataFrame) -> DataFrame:
    """Shares stacked for drawing: the second boundary is the sum of two."""
    return split.select(
        "ID",
        "CCGName",
        "PC_NHSLASpend",
        "PC_NonNHSLAVCSESpend",
        "PC_NonNHSLAVCSENonSpend",
        (F.col("PC_NHSLASpend") + F.col("PC_NonNHSLAVCSESpend")).alias("Line2"),
    )


def vcse_share_of_nonpublic(split: DataFrame) -> DataFrame:
    return _rerank(split.select("ID", "CCGName", "VCSEofNonNHSLASpend"), "VCSEofNonNHSLASpend")


def vcse_share_of_total(split: DataFrame) -> DataFrame:
    shares = split.select(
        "ID",
        "CCGName",
        "TotalSpend",
        "NonNHSLAVCSESpend",
        ratio("NonNHSLAVCSESpend", "TotalSpend").alias("PC_VCSESpend"),
    )
    return _rerank(shares, "PC_VCSESpend")


def per_capita_spend(split: DataFrame, population: DataFrame) -> DataFrame:
    """VCSE spending per inhabitant, ranked."""
    spend = split.select("ID", "CCGCode", "CCGName", "NonNHSLAVCSESpend")
    joined = attach(spend, population, "CCGCode")
    return _rerank(
        joined.withColumn("PerCapitaVCSESpend", ratio("NonNHSLAVCSESpend", "Mid2018Pop")),
        "PerCapitaVCSESpend",
    )


def case_study_flag(per_capita: DataFrame, ranks: list[int] = CASE_STUDY_RANKS) -> DataFrame:
    return flag_ranks(per_capita, "ID", ranks, "CaseStudyShortList")


def rank_quartile(per_capita: DataFrame) -> DataFrame:
    return rank_bands(per_capita, "ID", "Quartile")


def successor_rollup(per_capita: DataFrame, lookup: DataFrame) -> DataFrame:
    """Spending and population of the successor units and spending per capita."""
    units = rollup_geography(
        per_capita,
        lookup,
        "CCGCode2020",
        {
            "VCSESpend": strict_sum("NonNHSLAVCSESpend"),
            "Population": strict_sum("Mid2018Pop"),
        },
    )
    return units.withColumn("PercapitaSpend", ratio("VCSESpend", "Population"))


def successor_rank(
    units: DataFrame, excluded: list[str] = EXCLUDED_SUCCESSORS, key: str = "CCGCode2020"
) -> DataFrame:
    """Rank of the successor units left after dropping the excluded ones."""
    kept = exclude(units, key, excluded)
    return global_rank(kept, [descending("PercapitaSpend"), ascending("CCGCode2020")], "ID")


def complete_successor_rank(units: DataFrame, present: DataFrame, lookup: DataFrame) -> DataFrame:
    """The same rank with the units derived: every one missing a component goes.

    ``present`` is any frame with the codes of the bodies that are there.
    """
    gone = incomplete_successors(present, lookup, "CCGCode2020")
    kept = units.filter(F.col("CCGCode2020").isNotNull()).join(gone, "CCGCode2020", "left_anti")
    return global_rank(kept, [descending("PercapitaSpend"), ascending("CCGCode2020")], "ID")


def successor_case_study(
    ranked: DataFrame,
    ranks: list[int] = SUCCESSOR_CASE_STUDY_RANKS,
    cuts: list[float] = SUCCESSOR_CUTS,
) -> DataFrame:
    banded = rank_bands(ranked, "ID", "Quartile", cuts=cuts)
    return flag_ranks(banded, "ID", ranks, "CaseStudy")
