"""VCSE suppliers of the extract. These frames grow with the supplier list."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import all_of, cond_sum, count_if, flag_on, ratio
from tallybook.operators import ascending, descending, range_rank, two_level
from tallybook.plans.sectors import STANDARD

SPEND_CUTS = [50_000_000, 10_000_000, 1_000_000, 500_000]
TOP_CUT = 50_000_000
SPENDING_ORDER = [descending("Spending"), ascending(STANDARD)]


def _vcse_spending(extract: DataFrame) -> DataFrame:
    return (
        extract.filter(flag_on("VCSE_Status"))
        .groupBy(STANDARD)
        .agg(F.sum("Invoices").alias("Invoices"), F.sum("Spending").alias("Spending"))
    )


def vcse_suppliers(extract: DataFrame) -> DataFrame:
    """Invoices and spending per VCSE supplier, ranked by spending."""
    ranked = range_rank(_vcse_spending(extract), SPENDING_ORDER, "ID")
    return ranked.select("ID", STANDARD, "Invoices", "Spending")


def vcse_top_names(extract: DataFrame, cut: float = TOP_CUT) -> DataFrame:
    """Suppliers above a spending cut.

    All larger suppliers are above the cut too, so ranks inside the selection
    are ranks among all suppliers.
    """
    top = _vcse_spending(extract).filter(F.col("Spending") > cut)
    return range_rank(top, SPENDING_ORDER, "ID").select("ID", STANDARD, "Spending")


def spend_bands(extract: DataFrame, cuts: list[float] = SPEND_CUTS) -> DataFrame:
    """Suppliers above each cut: number, share of suppliers, share of spending.

    The bands overlap. All cuts are read off in one aggregation, then turned
    into one row each.
    """
    spending = F.col("Spending")

    def band(cut: float) -> Column:
        above = spending > cut
        return F.struct(
            F.lit(int(cut)).cast("long").alias("Threshold"),
            count_if(above).alias("Suppliers"),
            ratio(count_if(above), F.count(F.lit(1))).alias("ShareOfSuppliers"),
            ratio(cond_sum(spending, above), F.sum(spending)).alias("ShareOfSpending"),
        )

    bands = _vcse_spending(extract).agg(F.array(*[band(cut) for cut in cuts]).alias("_bands"))
    return bands.select(F.inline("_bands"))


def vcse_body_counts(extract: DataFrame) -> DataFrame:
    """Number of bodies each VCSE supplier serves, and its spending."""
    return two_level(
        extract.filter(flag_on("VCSE_Status")), [STANDARD], ["CCGName"], "CCGCount", ["Spending"]
    )


BODY_COUNT_ORDER = [descending("CCGCount"), ascending(STANDARD)]


class OpenRange(NamedTuple):
    """Open bounds on spending and body count; None is no bound."""

    label: str
    spending_over: float | None = None
    spending_under: float | None = None
    bodies_over: int | None = None
    bodies_under: int | None = None

    def condition(self) -> Column:
        bounds = [
            (self.spending_over, lambda b: F.col("Spending") > b),
            (self.spending_under, lambda b: F.col("Spending") < b),
            (self.bodies_over, lambda b: F.col("CCGCount") > b),
            (self.bodies_under, lambda b: F.col("CCGCount") < b),
        ]
        return all_of([test(bound) for bound, test in bounds if bound is not None])


# The six groups of suppliers that stand out.
OUTLIER_RANGES = [
    OpenRange("high spend", spending_over=50e6, bodies_under=40),
    OpenRange("few bodies", spending_over=24e6, spending_under=50e6, bodies_over=5, bodies_under=9),
    OpenRange("most bodies", bodies_over=45),
    OpenRange("mid", spending_over=20e6, spending_under=35e6, bodies_over=10, bodies_under=20),
    OpenRange("many bodies", spending_under=25e6, bodies_over=27, bodies_under=35),
    OpenRange("more bodies", spending_under=25e6, bodies_over=35, bodies_under=40),
]


def vcse_outliers(extract: DataFrame, ranges: list[OpenRange] = OUTLIER_RANGES) -> DataFrame:
    """Suppliers inside the given ranges, once per range they are in."""
    marks = [F.when(r.condition(), F.lit(r.label)) for r in ranges]
    return vcse_body_counts(extract).select(
        F.explode(F.array_compact(F.array(*marks))).alias("Outlier"), STANDARD, "CCGCount", "Spending"
    )


def supplier_by_body(extract: DataFrame, names: list[str]) -> DataFrame:
    """What the named suppliers receive from each body."""
    return (
        extract.filter(F.col(STANDARD).isin(names))
        .groupBy(STANDARD, "CCGName")
        .agg(F.sum("Spending").alias("Spend"))
    )
