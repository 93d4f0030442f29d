"""Coverage, completeness and threshold figures of the full ledger.

All functions take a ledger tally; those that name no supplier attribute also
take bare measures without a supplier join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import cond_sum, flag_on, ratio, total
from tallybook.operators import (
    ascending,
    descending,
    global_rank,
    group_with_attribute,
    keys_present,
)
from tallybook.plans.enrich import valid_supplier


def _in_extract() -> Column:
    return (F.col("Overs") > 0) & valid_supplier()


def bodies_covered(ledger: DataFrame) -> DataFrame:
    """Body codes in the full ledger and in the extract, in one scan."""
    per_body = ledger.groupBy("CCGCode").agg(
        F.max(F.when(_in_extract(), 1).otherwise(0)).alias("_extract")
    )
    return per_body.agg(
        F.count(F.lit(1)).alias("FullBodies"),
        total("_extract").alias("ExtractBodies"),
    )


def bad_records(ledger: DataFrame) -> DataFrame:
    """Records without a usable supplier: count and share."""
    bad = (
        F.col("Supplier").isNull()
        | flag_on("Redacted")
        | flag_on("PHB_CHC")
        | flag_on("Uninformative")
    )
    count = cond_sum("Records", bad)
    return ledger.agg(
        count.alias("BadRecords"), ratio(count, F.sum("Records")).alias("ShareOfRecords")
    )


def missing_expense_totals(ledger: DataFrame) -> DataFrame:
    rows, area, kind = total("Records"), total("MissingEA"), total("MissingET")
    return ledger.agg(
        area.alias("MissingEA"),
        ratio(area, rows).alias("ShareEA"),
        kind.alias("MissingET"),
        ratio(kind, rows).alias("ShareET"),
    )


def missing_by_body(ledger: DataFrame) -> DataFrame:
    """Both missing counts, their shares and the summed indicator per body."""
    counted = ledger.groupBy("CCGName").agg(
        total("Records").alias("TotalRecords"),
        total("MissingEA").alias("MissingEA"),
        total("MissingET").alias("MissingET"),
    )
    return (
        counted.withColumn("Percent_EA", ratio("MissingEA", "TotalRecords"))
        .withColumn("Percent_ET", ratio("MissingET", "TotalRecords"))
        .withColumn("Indicator", F.col("Percent_EA") + F.col("Percent_ET"))
    )


AREA_ORDER = [descending("Percent_EA"), ascending("CCGName")]
TYPE_ORDER = [descending("Percent_ET"), ascending("CCGName")]
# The indicator is sorted after the area share, which therefore breaks ties.
INDICATOR_ORDER = [descending("Indicator"), *AREA_ORDER]


def missing_area_by_body(ledger: DataFrame) -> DataFrame:
    return missing_by_body(ledger).select("CCGName", "TotalRecords", "MissingEA", "Percent_EA")


def missing_type_by_body(ledger: DataFrame) -> DataFrame:
    return missing_by_body(ledger).select("CCGName", "TotalRecords", "MissingET", "Percent_ET")


def missing_concentration(ledger: DataFrame, top: int = 14) -> DataFrame:
    """Share of all missing entries that the worst bodies account for."""
    ranked = global_rank(missing_by_body(ledger), INDICATOR_ORDER, "_rank")
    missing = F.col("MissingEA") + F.col("MissingET")
    share = ratio(cond_sum(missing, F.col("_rank") <= top), F.sum(missing))
    return ranked.agg(share.alias("ShareOfMissing"))


def _if_all_known(value: Column) -> Column:
    """A sum over amounts is unknown as soon as one amount is."""
    return F.when(F.sum("Known") == F.sum("Records"), value)


def ledger_totals(ledger: DataFrame) -> DataFrame:
    payments = _if_all_known(F.sum("Payments"))
    return ledger.agg(
        total("Records").alias("Records"),
        payments.alias("Payments"),
        _if_all_known(F.sum("Spending")).alias("Spending"),
        (total("Records") - payments).alias("IncomeRecords"),
        _if_all_known(F.sum("Income")).alias("Income"),
    )


def threshold_totals(ledger: DataFrame) -> DataFrame:
    """Invoices from the threshold on against all payments."""
    count, value = total("Overs"), total("OverSpending")
    return ledger.agg(
        count.alias("OverInvoices"),
        ratio(count, _if_all_known(F.sum("Payments"))).alias("ShareOfPayments"),
        value.alias("OverSpending"),
        ratio(value, _if_all_known(F.sum("Spending"))).alias("ShareOfSpending"),
    )


def threshold_counts(ledger: DataFrame) -> DataFrame:
    """Payments per body, and those from the threshold on."""
    return group_with_attribute(
        ledger.filter(F.col("Payments") > 0),
        "CCGName",
        "CCGCode",
        {"Over": F.sum("Overs"), "Total": F.sum("Payments")},
    )


def threshold_shares(counts: DataFrame) -> DataFrame:
    """Shares over and under the threshold, ranked by the share under it."""
    shared = counts.withColumn("PercentOver", ratio("Over", "Total")).withColumn(
        "PercentUnder", 1 - F.col("PercentOver")
    )
    return global_rank(shared, [ascending("PercentUnder"), ascending("CCGName")], "CCG")


def threshold_split(ledger: DataFrame) -> DataFrame:
    return threshold_shares(threshold_counts(ledger))


def nested_supplier_counts(ledger: DataFrame, name: str) -> DataFrame:
    """Suppliers in the ledger, among payments, over the threshold, in the extract.

    One row per supplier with three marks, then a count of the marks: one scan
    and no copy of the rows per subset.
    """
    marks = {
        "Payments": F.col("Payments") > 0,
        "OverThreshold": F.col("Overs") > 0,
        "InExtract": _in_extract(),
    }
    per_supplier = ledger.groupBy(name).agg(
        *[F.max(F.when(c, 1).otherwise(0)).alias(f"_{n}") for n, c in marks.items()]
    )
    return per_supplier.agg(
        F.count(F.lit(1)).alias("InLedger"),
        *[total(f"_{n}").alias(n) for n in marks],
    )


def named_supplier_counts(ledger: DataFrame) -> DataFrame:
    return nested_supplier_counts(ledger, "Supplier")


def standard_supplier_counts(ledger: DataFrame) -> DataFrame:
    return nested_supplier_counts(ledger, "SUPPLIER_STANDARD_NAME")


def extract_totals(ledger: DataFrame) -> DataFrame:
    """Size of the extract and its share of all spending, in one scan.

    Suppliers are counted as marks on one row per raw, then per standard name,
    bodies on one row per body; so no row is copied for each kind of value that
    is counted, and both counts read the same sums.
    """
    measures = ["Records", "Known", "Overs", "Spending", "OverSpending"]
    columns = ["CCGName", "Supplier", "SUPPLIER_STANDARD_NAME", *measures]
    rows = ledger.withColumn("_inside", F.coalesce(_in_extract(), F.lit(False)).cast("int")).select(*columns, "_inside")
    extract = {m: F.sum(F.when(F.col("_inside") == 1, F.col(m))) for m in ("Overs", "OverSpending")}
    per_name = rows.groupBy("SUPPLIER_STANDARD_NAME", "Supplier").agg(
        F.max("_inside").alias("_named"),
        *[v.alias(f"_{m}") for m, v in extract.items()],
        *[F.sum(m).alias(m) for m in ("Records", "Known", "Spending")],
    )
    sums = ["_Overs", "_OverSpending", "Records", "Known", "Spending"]
    per_standard = per_name.groupBy("SUPPLIER_STANDARD_NAME").agg(
        F.sum("_named").alias("_named"), F.max("_named").alias("_standard"), *[F.sum(c).alias(c) for c in sums]
    )
    bodies = keys_present(rows, "CCGName", F.max("_inside").alias("_body")).agg(total("_body")).scalar()
    value = total("_OverSpending")
    return per_standard.agg(
        total("_Overs").alias("Invoices"),
        F.max(bodies).alias("Bodies"),
        total("_named").alias("NamedSuppliers"),
        total("_standard").alias("StandardSuppliers"),
        value.alias("Spending"),
        ratio(value, _if_all_known(F.sum("Spending"))).alias("ShareOfSpending"),
    )
