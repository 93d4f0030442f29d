"""Small frames for tests."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from tallybook.plans import collate
from tallybook.schemas import INVOICES, SUPPLIERS


def frame(spark, columns: str, rows: list[tuple]):
    """A small frame from a DDL schema; money may be given as text."""
    return spark.createDataFrame(rows, columns)


def invoices(spark, rows: list[tuple]):
    """Invoices from (name, code, supplier, amount) with flags computed."""
    money = [(n, c, s, None if a is None else Decimal(str(a))) for n, c, s, a in rows]
    base = spark.createDataFrame(
        money, "CCGName string, CCGCode string, Supplier string, Amount decimal(18,2)"
    )
    typed = base.withColumn("ExpenseType", F.lit("T")).withColumn("ExpenseArea", F.lit("A"))
    flagged = collate.threshold_flag(collate.sign_split(typed))
    return flagged.select(*INVOICES.names)


def master(spark, rows: list[dict]):
    """Supplier master; columns not given are 0, names follow the key."""
    full = []
    for row in rows:
        values = {
            f.name: 0 if f.dataType.simpleString() == "int" else None for f in SUPPLIERS.fields
        }
        values["SUPPLIER_STANDARD_NAME"] = row["Supplier"]
        values["SupplierSector"] = "Other"
        values["CCCH_Status"] = "NotCCorCH"
        values.update(row)
        full.append(tuple(values[c] for c in SUPPLIERS.names))
    return spark.createDataFrame(full, SUPPLIERS)


def tuples(df, *columns: str) -> list[tuple]:
    return [tuple(row) for row in (df.select(*columns) if columns else df).collect()]
