"""From raw ledger files to clean invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions import distinct_with_null, strict_sum
from tallybook.operators import ascending, attach, global_rank, recode
from tallybook.schemas import LEDGER_COLUMNS, MONEY, RAW_LEDGER

THRESHOLD = 25000
TEXT_COLUMNS = ["CCGName", "CCGCode", "ExpenseType", "ExpenseArea", "Supplier"]

# Same-named suppliers told apart by the code of the paying body.
SUPPLIER_RULES = [
    (
        ["E38000072", "E38000088", "E38000186"],
        ["ST JOSEPHS HOSPICE"],
        "ST JOSEPHS HOSPICE (HACKNEY)",
    ),
    (["E38000101", "E38000161"], ["ST JOSEPHS HOSPICE"], "ST JOSEPHS HOSPICE (LIVERPOOL)"),
    (
        ["E38000073"],
        ["ST MICHAELS HOSPICE", "ST MICHAEL'S HOSPICE"],
        "ST MICHAELS HOSPICE (HARROGATE)",
    ),
    (
        ["E38000076"],
        ["ST MICHAELS HOSPICE", "ST MICHAEL'S HOSPICE"],
        "ST MICHAEL'S HOSPICE (HASTINGS)",
    ),
    (
        ["E38000078"],
        ["ST MICHAELS HOSPICE", "ST MICHAEL'S HOSPICE"],
        "ST MICHAEL'S HOSPICE (HEREFORDSHIRE)",
    ),
]


def friendly_names(raw: DataFrame) -> DataFrame:
    """The five ledger columns under their short names; other columns stay."""
    return raw.withColumnsRenamed(dict(zip(RAW_LEDGER.names, LEDGER_COLUMNS)))


def file_summary(
    raw: DataFrame, file_column: str = "File", manifest: DataFrame | None = None
) -> DataFrame:
    """Per source file: first entity, suppliers, invoices and net amount.

    Rows are combined per file, supplier and entity, then per file and
    supplier, so a file holding most of the ledger is never gathered in one
    task, and suppliers are counted as rows. With a manifest every file it
    names has a line, numbered in its order; one without rows has no entity
    and counts of 0. Without one, the files that have rows are numbered by name.
    """
    amount = F.col("`AP Amount (£)`")
    per_entity = raw.groupBy(file_column, "Supplier", "Entity").agg(
        F.count(F.lit(1)).alias("Invoices"),
        F.count(amount).alias("_known"),
        F.sum(amount).alias("Amount"),
    )
    per_supplier = per_entity.groupBy(file_column, "Supplier").agg(
        F.min("Entity").alias("Entity"),
        F.sum("Invoices").alias("Invoices"),
        F.sum("_known").alias("_known"),
        F.sum("Amount").alias("Amount"),
    )
    per_file = per_supplier.groupBy(file_column).agg(
        F.min("Entity").alias("CCG"),
        F.count(F.lit(1)).alias("Suppliers"),
        F.sum("Invoices").alias("Invoices"),
        F.when(F.sum("_known") == F.sum("Invoices"), F.sum("Amount")).alias("Amount"),
    )
    if manifest is None:
        return global_rank(per_file, [ascending(file_column)], "Count")
    # A manifest is one small file, read in its order.
    listed = manifest.select(F.col("FileName").alias(file_column)).withColumn(
        "_line", F.monotonically_increasing_id()
    )
    lines = listed.join(per_file, file_column, "left").withColumns(
        {
            "Suppliers": F.coalesce("Suppliers", F.lit(0)),
            "Invoices": F.coalesce("Invoices", F.lit(0)),
            "Amount": F.when(F.col("Invoices").isNull(), 0).otherwise(F.col("Amount")),
        }
    )
    return global_rank(lines, [ascending("_line")], "Count").drop("_line")


def collation_check(raw: DataFrame) -> DataFrame:
    """Bodies, records and net amount of the whole collation."""
    return raw.agg(
        distinct_with_null("Entity").alias("Bodies"),
        F.count(F.lit(1)).alias("Records"),
        strict_sum("`AP Amount (£)`").alias("NetAmount"),
    )


def attach_body_code(ledger: DataFrame, body_codes: DataFrame) -> DataFrame:
    """Add the code of the paying body, found by its local (mixed-case) name."""
    codes = body_codes.select(F.col("OurNames").alias("CCGName"), F.col("CCG18CD").alias("CCGCode"))
    coded = attach(ledger, codes, "CCGName")
    order = ["CCGName", "CCGCode", *LEDGER_COLUMNS[1:]]
    return coded.select([c for c in order if c in coded.columns])


def sign_split(invoices: DataFrame) -> DataFrame:
    """Positive amounts are spending, the rest (zero included) is income."""
    amount = F.col("Amount")
    nothing = F.lit(0).cast(MONEY)
    return invoices.withColumns(
        {
            "PositiveFlag": (amount > 0).cast("int"),
            "Income": F.when(amount <= 0, amount).when(amount > 0, nothing),
            "Spending": F.when(amount > 0, amount).when(amount <= 0, nothing),
        }
    )


def threshold_flag(invoices: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """1 from the threshold on (inclusive)."""
    return invoices.withColumn("InvoiceOver25k", (F.col("Amount") >= threshold).cast("int"))


def normalise_text(invoices: DataFrame) -> DataFrame:
    """Upper-case the text columns."""
    present = [c for c in TEXT_COLUMNS if c in invoices.columns]
    return invoices.withColumns({c: F.upper(c) for c in present})


def recode_suppliers(invoices: DataFrame, rules=SUPPLIER_RULES) -> DataFrame:
    return recode(invoices, rules, "CCGCode", "Supplier")


def clean_ledger(
    raw: DataFrame, body_codes: DataFrame, threshold: int = THRESHOLD, rules=SUPPLIER_RULES
) -> DataFrame:
    """Raw ledger rows to ``invoices``: one narrow pass plus the code lookup."""
    coded = attach_body_code(friendly_names(raw), body_codes)
    clean = normalise_text(threshold_flag(sign_split(coded), threshold))
    return recode_suppliers(clean, rules) if rules else clean


def unique_suppliers(invoices: DataFrame) -> DataFrame:
    """Supplier names as they stand in the ledger, NULL included."""
    return invoices.select("Supplier").distinct()
