"""Profile of chosen bodies among all bodies.

Every function ranks all bodies (or successor units). :func:`chosen` then picks
some of them, so that ranks refer to the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import flag_on, null_if_zero, ratio, strict_sum
from tallybook.operators import ascending, descending, exclude, global_rank, rollup_geography, sort_columns
from tallybook.plans.sectors import STANDARD

# Successor units with a component that has no ledger.
EXCLUDED_SUCCESSOR_NAMES = [
    "NHS West Sussex CCG",
    "NHS Bradford District and Craven CCG",
    "NHS Cheshire CCG",
]


def chosen(df: DataFrame, names: list[str], key: str = "CCGName") -> DataFrame:
    """Rows of the named bodies, after ranking."""
    return df.filter(F.col(key).isin(names))


def _two_ranks(
    df: DataFrame, key: str, first: tuple[str, str], second: tuple[str, str]
) -> DataFrame:
    """Two ranks in a row; the order of the first breaks ties of the second."""
    once = global_rank(df, [descending(first[0]), ascending(key)], first[1])
    return global_rank(once, [descending(second[0]), ascending(first[1])], second[1])


# Per-body sums. They serve both geographies.


def _vcse_sums(payments: DataFrame, by: list[str]) -> DataFrame:
    return (
        payments.filter(flag_on("VCSE_Status"))
        .groupBy(*by)
        .agg(F.sum("Spending").alias("TotVCSESpend"), F.sum("Invoices").alias("Invoices"))
    )


def _invoice_sums(payments: DataFrame, by: list[str]) -> DataFrame:
    return payments.groupBy(*by).agg(
        F.sum("Invoices").alias("TotInvoices"),
        strict_sum(F.col("VCSE_Status") * F.col("Invoices")).alias("VCSEInvoices"),
    )


def _value_sums(payments: DataFrame, by: list[str]) -> DataFrame:
    return payments.groupBy(*by).agg(
        F.sum("Spending").alias("TotValue"),
        strict_sum(F.col("VCSE_Status") * F.col("Spending")).alias("VCSESpend"),
    )


def _supplier_sums(payments: DataFrame, by: list[str]) -> DataFrame:
    """Suppliers and value per body, all and VCSE, from one scan.

    A body without VCSE suppliers keeps NULL in the VCSE columns.
    """
    vcse = flag_on("VCSE_Status")
    per_supplier = payments.groupBy(*by, STANDARD).agg(
        F.sum("Spending").alias("_value"),
        F.max(F.when(vcse, 1).otherwise(0)).alias("_vcse"),
        F.sum(F.when(vcse, F.col("Spending"))).alias("_vcse_value"),
    )
    return per_supplier.groupBy(*by).agg(
        F.count(F.lit(1)).alias("CountSuppliers"),
        F.sum("_value").alias("ValueSuppliers"),
        null_if_zero(F.sum("_vcse")).alias("CountVCSESuppliers"),
        F.sum("_vcse_value").alias("ValueVCSESuppliers"),
    )


# One row per body.


def profile_vcse_spend(payments: DataFrame) -> DataFrame:
    sums = _vcse_sums(payments, ["CCGName"])
    valued = sums.withColumn("PerTransaction", ratio("TotVCSESpend", "Invoices"))
    return _two_ranks(
        valued,
        "CCGName",
        ("TotVCSESpend", "VCSESpendRank"),
        ("PerTransaction", "VCSEPerTransactionRank"),
    )


def profile_vcse_invoice_share(payments: DataFrame) -> DataFrame:
    shared = _invoice_sums(payments, ["CCGName"]).withColumn(
        "PercentInvoicesVCSE", ratio("VCSEInvoices", "TotInvoices")
    )
    return global_rank(shared, [descending("PercentInvoicesVCSE"), ascending("CCGName")], "Rank")


def profile_vcse_value_share(payments: DataFrame) -> DataFrame:
    """VCSE share of value; fed with the extract it covers large payments only."""
    shared = _value_sums(payments, ["CCGName"]).withColumn(
        "PercentVCSESpend", ratio("VCSESpend", "TotValue")
    )
    return global_rank(shared, [descending("PercentVCSESpend"), ascending("CCGName")], "Rank")


def profile_supplier_counts(payments: DataFrame) -> DataFrame:
    return _supplier_sums(payments, ["CCGName"])


def profile_supplier_share_rank(payments: DataFrame) -> DataFrame:
    """Both ranks follow the share of suppliers, also the one called ValueRank."""
    shared = (
        profile_supplier_counts(payments)
        .withColumn("PercentCountVCSE", ratio("CountVCSESuppliers", "CountSuppliers"))
        .withColumn("PercentSpendVCSE", ratio("ValueVCSESuppliers", "ValueSuppliers"))
    )
    return _two_ranks(
        shared, "CCGName", ("PercentCountVCSE", "CountRank"), ("PercentCountVCSE", "ValueRank")
    )


def profile_supplier_count_rank(payments: DataFrame) -> DataFrame:
    shared = profile_supplier_counts(payments).withColumn(
        "PercentCountVCSE", ratio("CountVCSESuppliers", "CountSuppliers")
    )
    return _two_ranks(
        shared, "CCGName", ("CountVCSESuppliers", "CountRank"), ("PercentCountVCSE", "PercentRank")
    )


# One row per successor unit. Per-body figures are added, not counted again.

_CODED = ["CCGCode", "CCGName"]


def _successors(
    sums: DataFrame, lookup: DataFrame, columns: dict[str, Column], excluded: list[str]
) -> DataFrame:
    return exclude(rollup_geography(sums, lookup, "CCGName2020", columns), "CCGName2020", excluded)


def successor_vcse_spend(
    payments: DataFrame, lookup: DataFrame, excluded: list[str] = EXCLUDED_SUCCESSOR_NAMES
) -> DataFrame:
    columns = {"VCSESpend": F.sum("TotVCSESpend"), "TotInvoices": F.sum("Invoices")}
    units = _successors(_vcse_sums(payments, ["CCGCode"]), lookup, columns, excluded)
    valued = units.withColumn("PertransactionSpend", ratio("VCSESpend", "TotInvoices"))
    return _two_ranks(
        valued,
        "CCGName2020",
        ("VCSESpend", "VCSESpendRank"),
        ("PertransactionSpend", "PertransactionSpendRank"),
    )


def successor_invoice_share(
    payments: DataFrame, lookup: DataFrame, excluded: list[str] = EXCLUDED_SUCCESSOR_NAMES
) -> DataFrame:
    """Share of invoices; its column name is the one the report uses."""
    columns = {"VCSEInvoices": strict_sum("VCSEInvoices"), "TotInvoices": F.sum("TotInvoices")}
    units = _successors(_invoice_sums(payments, ["CCGCode"]), lookup, columns, excluded)
    shared = units.withColumn("PertransactionSpend", ratio("VCSEInvoices", "TotInvoices"))
    return global_rank(shared, [descending("PertransactionSpend"), ascending("CCGName2020")], "Rank")


def successor_value_share(
    payments: DataFrame,
    lookup: DataFrame,
    excluded: list[str] = EXCLUDED_SUCCESSOR_NAMES,
    rank: str = "Rank",
) -> DataFrame:
    columns = {"TotValue": F.sum("TotValue"), "VCSESpend": strict_sum("VCSESpend")}
    units = _successors(_value_sums(payments, ["CCGCode"]), lookup, columns, excluded)
    shared = units.withColumn("PercentVCSESpend", ratio("VCSESpend", "TotValue"))
    return global_rank(shared, [descending("PercentVCSESpend"), ascending("CCGName2020")], rank)


def successor_supplier_counts(
    payments: DataFrame, lookup: DataFrame, excluded: list[str] = EXCLUDED_SUCCESSOR_NAMES
) -> DataFrame:
    """A supplier serving two merged bodies is counted at both."""
    names = ["CountSuppliers", "ValueSuppliers", "CountVCSESuppliers", "ValueVCSESuppliers"]
    columns = {name: strict_sum(name) for name in names}
    units = _successors(_supplier_sums(payments, _CODED), lookup, columns, excluded)
    shared = units.withColumn(
        "PercentVCSESuppliers", ratio("CountVCSESuppliers", "CountSuppliers")
    )
    return _two_ranks(
        shared,
        "CCGName2020",
        ("CountVCSESuppliers", "CountRank"),
        ("PercentVCSESuppliers", "PercentRank"),
    )


def body_names(invoices: DataFrame) -> DataFrame:
    """Names of the paying bodies, sorted."""
    return invoices.select("CCGName").distinct().orderBy(*sort_columns([ascending("CCGName")]))
