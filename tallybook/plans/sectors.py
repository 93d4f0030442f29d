"""Where the money of the extract goes: sectors, public bodies, GP services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions import cond_sum, count_if, flag_on, ratio
from tallybook.operators import (
    add_shares,
    ascending,
    descending,
    global_rank,
    group_with_attribute,
    nth_rows,
    pivot_with_total,
    share_of_total,
    total_row,
)
from tallybook.schemas import SECTORS

STANDARD = "SUPPLIER_STANDARD_NAME"
PUBLIC_SECTORS = ["NHS", "LA"]


def sector_split(extract: DataFrame) -> DataFrame:
    """Invoices and spending per sector with their shares."""
    split = extract.groupBy("SupplierSector").agg(
        F.sum("Invoices").alias("Invoices"), F.sum("Spending").alias("Expenditure")
    )
    return share_of_total(
        split, {"PercentInvoices": "Invoices", "PercentExpenditure": "Expenditure"}
    )


def public_share(extract: DataFrame) -> DataFrame:
    """Share of invoices and of spending going to NHS and local authorities."""
    public = F.col("SupplierSector").isin(PUBLIC_SECTORS)
    return extract.agg(
        ratio(cond_sum("Invoices", public), F.sum("Invoices")).alias("PercentInvoices"),
        ratio(cond_sum("Spending", public), F.sum("Spending")).alias("PercentExpenditure"),
    )


def sector_pivot_by_body(extract: DataFrame) -> DataFrame:
    """Spending per body and sector, side by side, with shares of the body."""
    wide = pivot_with_total(extract, "CCGName", "SupplierSector", SECTORS, F.sum("Spending"))
    return add_shares(wide, {sector: f"PC_{sector}" for sector in SECTORS})


def public_share_by_body(extract: DataFrame) -> DataFrame:
    """NHS and local authority share per body, ranked upwards."""
    wide = pivot_with_total(extract, "CCGName", "SupplierSector", SECTORS, F.sum("Spending"))
    share = wide.select("CCGName", ratio(F.col("LA") + F.col("NHS"), "Total").alias("PercentLA_NHS"))
    return global_rank(share, [ascending("PercentLA_NHS"), ascending("CCGName")], "CCG")


def body_supplier_breakdown(extract: DataFrame, body: str) -> DataFrame:
    """Suppliers of one body with their share of its spending."""
    suppliers = (
        extract.filter(F.col("CCGName") == body)
        .groupBy(STANDARD)
        .agg(F.sum("Invoices").alias("Invoices"), F.sum("Spending").alias("Spending"))
    )
    return share_of_total(suppliers, {"Percent": "Spending"})


def nth_supplier_share(extract: DataFrame, ranks: dict[str, list[int]]) -> DataFrame:
    """Share of a body's spending that its n-th largest suppliers receive.

    ``ranks`` gives the places wanted per body; all bodies are read in one scan.
    A place beyond the last supplier makes the share of its body NULL.
    """
    suppliers = (
        extract.filter(F.col("CCGName").isin(list(ranks)))
        .groupBy("CCGName", STANDARD)
        .agg(F.sum("Spending").alias("Spending"))
    )
    wanted = sorted({rank for places in ranks.values() for rank in places})
    order = [descending("Spending"), ascending(STANDARD)]
    top = nth_rows(suppliers, ["CCGName"], order, wanted)
    listed = F.lit(False)
    for body, places in ranks.items():
        listed = listed | ((F.col("CCGName") == body) & F.col("_position").isin(places))
    asked = F.lit(0)
    for body, places in ranks.items():
        asked = F.when(F.col("CCGName") == body, len(set(places))).otherwise(asked)
    complete = F.count(F.lit(1)) == F.max(asked)
    picked = (
        top.filter(listed)
        .groupBy("CCGName")
        .agg(F.when(complete, F.sum("Spending")).alias("_picked"))
    )
    whole = suppliers.groupBy("CCGName").agg(F.sum("Spending").alias("_whole"))
    return whole.join(picked, "CCGName", "left").select(
        "CCGName", ratio("_picked", "_whole").alias("Share")
    )


def gp_share_by_body(extract: DataFrame) -> DataFrame:
    """GP spending per body; a body without any keeps NULL, not 0."""
    gp = flag_on("GPServices")
    gp_code = extract.withColumn("CCGCode", F.when(gp, F.col("CCGCode")))
    sums = {
        "TotalSpend": F.sum("Spending"),
        "GPSpend": F.sum(F.when(gp, F.col("Spending"))),
    }
    per_body = group_with_attribute(gp_code, "CCGName", "CCGCode", sums)
    return per_body.withColumn("Percent_GPSpend", ratio("GPSpend", "TotalSpend"))


GP_ORDER = [ascending("Percent_GPSpend"), ascending("CCGName")]


def gp_share_rank(extract: DataFrame) -> DataFrame:
    shares = gp_share_by_body(extract).select("CCGName", "Percent_GPSpend")
    return global_rank(shares, GP_ORDER, "CCG")


def gp_supplier_count(extract: DataFrame) -> DataFrame:
    suppliers = extract.filter(flag_on("GPServices")).select(STANDARD).distinct()
    return suppliers.agg(F.count(F.lit(1)).alias("GPSuppliers"))


def gp_suppliers_for_bodies(extract: DataFrame, bodies: list[str]) -> DataFrame:
    """GP suppliers of the chosen bodies with a total row per body."""
    chosen = extract.filter(F.col("CCGName").isin(bodies) & flag_on("GPServices"))
    spend = chosen.groupBy("CCGName", STANDARD).agg(F.sum("Spending").alias("Spending"))
    return total_row(spend, STANDARD, ["Spending"], extra_keys=("CCGName",))


def flag_profile(extract: DataFrame, flag: str) -> DataFrame:
    """Suppliers, invoices and spending with a flag, each with its share.

    Rows are combined per supplier, then supplier rows are counted: one scan
    instead of one per figure.
    """
    on = flag_on(flag)
    per_supplier = extract.groupBy(STANDARD).agg(
        F.max(F.when(on, 1).otherwise(0)).alias("_on"),
        F.sum("Invoices").alias("_all_invoices"),
        cond_sum("Invoices", on).alias("_invoices"),
        F.sum("Spending").alias("_all_spending"),
        cond_sum("Spending", on).alias("_spending"),
    )
    suppliers = count_if(F.col("_on") == 1)
    invoices, spending = F.sum("_invoices"), F.sum("_spending")
    return per_supplier.agg(
        suppliers.alias("Suppliers"),
        ratio(suppliers, F.count(F.lit(1))).alias("ShareOfSuppliers"),
        invoices.alias("Invoices"),
        ratio(invoices, F.sum("_all_invoices")).alias("ShareOfInvoices"),
        spending.alias("Spending"),
        ratio(spending, F.sum("_all_spending")).alias("ShareOfSpending"),
    )
