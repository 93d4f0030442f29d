"""Ledger rows joined to the supplier master, and the frames reports start from.

Reports add up rows per body and per supplier. They read a *tally*: bodies and
suppliers with additive measures. A tally may have one row per ledger row or
one per body and supplier; every report sums the measures, so both give the
same figures, and a tally stored once answers all reports without another pass
over the ledger.

A tally is joined to the supplier master in one way at every size: ledger rows
are first added up per body and supplier, so the join shuffles groups and not
rows, and a supplier holding a third of the ledger arrives as one row per body
and map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import distinct_with_null, flag_on
from tallybook.operators import match_suppliers, unique_key
from tallybook.schemas import EXTRACT_COLUMNS, VALIDITY_FLAGS

BODY = ["CCGCode", "CCGName"]


def enrich_ledger(invoices: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Every invoice with what is known about its supplier."""
    return match_suppliers(invoices, suppliers)


def valid_supplier() -> Column:
    """A named supplier, not redacted, no personal budget, informative."""
    condition = F.col("Supplier").isNotNull()
    for flag in VALIDITY_FLAGS:
        condition = condition & (F.col(flag) == 0)
    return condition


def _over_threshold(invoices: DataFrame) -> DataFrame:
    return invoices.filter((F.col("InvoiceOver25k") == 1) & F.col("Supplier").isNotNull())


def _valid_master(suppliers: DataFrame) -> DataFrame:
    return suppliers.filter(valid_supplier())


def valid_extract(invoices: DataFrame, suppliers: DataFrame) -> DataFrame:
    """The analytical dataset: valid payments from the threshold on.

    Both sides are filtered before they meet, which is the same as filtering
    the enriched ledger and lets the master shrink to its valid rows.
    """
    master = _valid_master(unique_key(suppliers, "Supplier"))
    joined = _over_threshold(invoices).join(master, "Supplier", "inner")
    return joined.select([c for c in EXTRACT_COLUMNS if c in joined.columns])


def extract_from_combined(combined: DataFrame) -> DataFrame:
    """The same extract taken from a stored enriched ledger."""
    return combined.filter((F.col("InvoiceOver25k") == 1) & valid_supplier()).select(
        [c for c in EXTRACT_COLUMNS if c in combined.columns]
    )


def extract_summary(extract: DataFrame) -> DataFrame:
    return extract.agg(
        distinct_with_null("Supplier").alias("NamedSuppliers"),
        distinct_with_null("SUPPLIER_STANDARD_NAME").alias("StandardSuppliers"),
        F.count(F.lit(1)).alias("Invoices"),
        F.sum("Spending").alias("Spending"),
    )


def _measures(invoices: DataFrame) -> dict[str, Column]:
    """Additive measures of one invoice; ``Known`` marks one with an amount."""
    over = flag_on("InvoiceOver25k")
    measures = {
        "Records": F.lit(1),
        "Known": F.col("Amount").isNotNull().cast("int"),
        "Payments": F.when(flag_on("PositiveFlag"), 1).otherwise(0),
        "Overs": F.when(over, 1).otherwise(0),
        "Spending": F.col("Spending"),
        "Income": F.col("Income"),
        "OverSpending": F.when(over, F.col("Spending")),
    }
    for column, name in (("ExpenseArea", "MissingEA"), ("ExpenseType", "MissingET")):
        if column in invoices.columns:
            measures[name] = F.col(column).isNull().cast("int")
    return measures


def measured(invoices: DataFrame) -> DataFrame:
    """Measures per invoice, for figures that need no supplier attributes."""
    keys = [c for c in [*BODY, "Supplier"] if c in invoices.columns]
    return invoices.select(*keys, *[v.alias(k) for k, v in _measures(invoices).items()])


def _added_up(rows: DataFrame) -> DataFrame:
    keys = [c for c in [*BODY, "Supplier"] if c in rows.columns]
    sums = [F.sum(c).alias(c) for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*sums)


def _large_payments(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"Invoices": F.col("Overs"), "Spending": F.col("OverSpending")})


def ledger_tally(invoices: DataFrame, suppliers: DataFrame) -> DataFrame:
    """The whole ledger, one row per body and supplier; also the form to be stored."""
    return match_suppliers(_added_up(measured(invoices)), suppliers)


def extract_tally(invoices: DataFrame, suppliers: DataFrame) -> DataFrame:
    """The analytical dataset."""
    master = _valid_master(unique_key(suppliers, "Supplier"))
    rows = _large_payments(measured(_over_threshold(invoices)))
    return _added_up(rows).join(master, "Supplier", "inner")


def payments_tally(invoices: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Positive invoices of any size."""
    return payments_of(ledger_tally(invoices.filter(flag_on("PositiveFlag")), suppliers))


def payments_of(ledger: DataFrame) -> DataFrame:
    """Payments in a ledger tally; other rows add nothing to spending."""
    return ledger.filter(F.col("Payments") > 0).withColumn("Invoices", F.col("Payments"))


def extract_of(ledger: DataFrame) -> DataFrame:
    """The analytical dataset in a ledger tally."""
    return _large_payments(ledger.filter((F.col("Overs") > 0) & valid_supplier()))
