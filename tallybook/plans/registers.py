"""Register status, legal forms and the shared-body subset of the extract."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions import cond_sum, count_if, flag_on, ratio, strict_sum
from tallybook.operators import (
    add_shares,
    ascending,
    global_rank,
    map_categories,
    pivot_with_total,
    restrict_to_list,
    total_row,
    two_level,
)
from tallybook.operators.categories import display_order
from tallybook.plans.sectors import PUBLIC_SECTORS, STANDARD
from tallybook.schemas import (
    CATEGORY_ORDER,
    OTHER_CATEGORY,
    SECTOR_CATEGORIES,
    STATUS_SHARE_NAMES,
    STATUSES,
)

MILLION = 1e6


# Cross-tabulations: sector by register status.


def _per_raw_name(extract: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Rows combined per raw name first, so the pick below sees few of them."""
    keys = [STANDARD, "Supplier", "CCCH_Status", "SupplierSector"]
    return extract.groupBy(*keys).agg(*[c.alias(name) for name, c in measures.items()])


def _first_attributes() -> Column:
    """Status and sector of a standard name: those of its first raw name."""
    attributes = F.struct("CCCH_Status", "SupplierSector")
    return F.min_by(attributes, F.struct("Supplier", "CCCH_Status", "SupplierSector"))


def _with_category(crosstab: DataFrame) -> DataFrame:
    return map_categories(
        crosstab, "SupplierSector", "Category", SECTOR_CATEGORIES, OTHER_CATEGORY
    )


def _crosstab_report(crosstab: DataFrame) -> DataFrame:
    """Sectors rolled up to categories, a total row, fixed display order."""
    columns = [*STATUSES, "Total"]
    rolled = total_row(_with_category(crosstab), "Category", columns).drop("IsTotal")
    return display_order(rolled, "Category", CATEGORY_ORDER, "RowOrder")


def _supplier_counts(extract: DataFrame) -> DataFrame:
    names = _per_raw_name(extract, {"Invoices": F.sum("Invoices")})
    picked = names.groupBy(STANDARD).agg(_first_attributes().alias("_first"))
    return pivot_with_total(
        picked.select("_first.*"), "SupplierSector", "CCCH_Status", STATUSES, F.count(F.lit(1))
    )


def _spending_sums(extract: DataFrame) -> DataFrame:
    return pivot_with_total(
        extract, "SupplierSector", "CCCH_Status", STATUSES, F.sum("Spending")
    )


def supplier_crosstab(extract: DataFrame) -> DataFrame:
    return _with_category(add_shares(_supplier_counts(extract), STATUS_SHARE_NAMES))


def supplier_crosstab_report(extract: DataFrame) -> DataFrame:
    return _crosstab_report(_supplier_counts(extract))


def spending_crosstab(extract: DataFrame) -> DataFrame:
    return _with_category(add_shares(_spending_sums(extract), STATUS_SHARE_NAMES))


def spending_crosstab_report(extract: DataFrame) -> DataFrame:
    """Spending by category and status, in pounds and in millions."""
    report = _crosstab_report(_spending_sums(extract))
    millions = [
        (F.col(f"`{c}`").cast("double") / MILLION).alias(f"{c}_millions")
        for c in [*STATUSES, "Total"]
    ]
    return report.select("*", *millions)


def unregistered_share(extract: DataFrame) -> DataFrame:
    """Organisations in neither register, outside NHS and local authorities.

    The supplier count uses a supplier's first attributes, the spending those
    of every row, as the two tables do. A missing sector counts as outside.
    """
    neither = STATUSES[-1]

    def outside(status: Column, sector: Column) -> Column:
        return (status == neither) & ~F.coalesce(sector, F.lit("")).isin(PUBLIC_SECTORS)

    row = outside(F.col("CCCH_Status"), F.col("SupplierSector"))
    names = _per_raw_name(extract, {"Spending": F.sum("Spending")})
    per_supplier = names.groupBy(STANDARD).agg(
        _first_attributes().alias("_first"),
        cond_sum("Spending", row).alias("_outside"),
        F.sum("Spending").alias("_all"),
    )
    suppliers = count_if(outside(F.col("_first.CCCH_Status"), F.col("_first.SupplierSector")))
    return per_supplier.agg(
        suppliers.alias("Suppliers"),
        ratio(suppliers, F.count(F.lit(1))).alias("ShareOfSuppliers"),
        F.sum("_outside").alias("Spending"),
        ratio(F.sum("_outside"), F.sum("_all")).alias("ShareOfSpending"),
    )


# The subset of bodies shared with another project.


def shared_subset(
    shared: DataFrame, extract: DataFrame, present: DataFrame | None = None
) -> DataFrame:
    """Extract rows of the listed bodies; a body without any gives a NULL row.

    ``present`` is a narrower frame with the bodies of the extract, such as its
    tally, if there is one.
    """
    return restrict_to_list(shared, extract, "CCGName", present)


def register_counts_subset(shared: DataFrame, extract: DataFrame) -> DataFrame:
    """Distinct charities and companies in the shared subset."""
    listed = extract.join(shared, "CCGName", "left_semi")
    per_supplier = listed.groupBy(STANDARD).agg(
        F.max(F.when(flag_on("CCFound"), 1).otherwise(0)).alias("_charity"),
        F.max(F.when(flag_on("CHFound"), 1).otherwise(0)).alias("_company"),
    )
    return per_supplier.agg(
        count_if(F.col("_charity") == 1).alias("Charities"),
        count_if(F.col("_company") == 1).alias("Companies"),
    )


def register_flags_by_body(shared: DataFrame, extract: DataFrame) -> DataFrame:
    """Invoices of charities and of companies per listed body.

    A listed body without rows has unknown flags, so its sums are NULL.
    """
    per_body = extract.groupBy("CCGName").agg(
        strict_sum(F.col("CCFound") * F.col("Invoices")).alias("Charities"),
        strict_sum(F.col("CHFound") * F.col("Invoices")).alias("Companies"),
    )
    copies = shared.groupBy("CCGName").agg(F.count(F.lit(1)).alias("_copies"))
    return copies.join(per_body, "CCGName", "left").select(
        "CCGName",
        *[(F.col(c) * F.col("_copies")).alias(c) for c in ("Charities", "Companies")],
    )


# Legal forms in seven segments.


def _private() -> Column:
    return (F.col("NHS") == 0) & (F.col("LA") == 0) & (F.col("GOV") == 0)


def segment_conditions() -> dict[str, Column]:
    charity, company, vcse = F.col("CCFound"), F.col("CHFound"), F.col("VCSE_Status")
    return {
        "CC_CH": (charity == 1) & (company == 1),
        "CC_ONLY": (charity == 1) & (company == 0),
        "CH_VCSE": (charity == 0) & (company == 1) & (vcse == 1) & _private(),
        "CH_NONVCSE": (charity == 0) & (company == 1) & (vcse == 0) & _private(),
        "PUBLIC": (F.col("NHS") == 1) | (F.col("LA") == 1) | (F.col("GOV") == 1),
        "NONE_VCSE": (charity == 0) & (company == 0) & _private() & (vcse == 1),
        "NONE_NONVCSE": (charity == 0) & (company == 0) & _private() & (vcse == 0),
    }


VCSE_SEGMENTS = ["CC_CH", "CC_ONLY", "CH_VCSE", "NONE_VCSE"]


def legal_form_segment(extract: DataFrame, segment: str) -> DataFrame:
    """Suppliers and spending by legal form (by sector for public bodies)."""
    form = "SupplierSector" if segment == "PUBLIC" else "GivenCompanyCategory"
    rows = extract.filter(segment_conditions()[segment])
    return two_level(rows, [form], [STANDARD], "Suppliers", ["Spending"])


def legal_forms(extract: DataFrame) -> DataFrame:
    """All seven segments in one scan.

    A row carries every segment it meets, so segments may overlap just as the
    separate filters may.
    """
    marks = [F.when(c, F.lit(name)) for name, c in segment_conditions().items()]
    placed = extract.select(
        F.explode(F.array_compact(F.array(*marks))).alias("Segment"),
        "SupplierSector",
        "GivenCompanyCategory",
        STANDARD,
        "Spending",
    )
    form = F.when(F.col("Segment") == "PUBLIC", F.col("SupplierSector")).otherwise(
        F.col("GivenCompanyCategory")
    )
    return two_level(
        placed.withColumn("Form", form), ["Segment", "Form"], [STANDARD], "Suppliers", ["Spending"]
    )


class FormRow(NamedTuple):
    """One line (or run of lines) of the legal-form report.

    ``positions`` are places of legal forms in their sorted order inside the
    segment; None stands for all of them. Forms under one label are added up;
    without a label every form keeps a line under its own name.
    """

    segment: str
    positions: list[int] | None
    label: str | None


# The lines of the report, by place of the form in its segment.
REPORT_ROWS = [
    FormRow("CC_CH", [1], None),
    FormRow("CC_CH", [3, 4, 5, 6, 7], "Private Limited Companies by guarantee"),
    FormRow("CC_CH", [2, 8], "Other Company Types"),
    FormRow("CC_ONLY", None, "Named charities"),
    FormRow("CH_VCSE", [1, 2, 8, 9], None),
    FormRow("CH_VCSE", [3, 4, 5, 7], "Private Limited Companies by guarantee"),
    FormRow("CH_VCSE", [6], None),
    FormRow("CH_NONVCSE", [7, 8, 9, 11], "Private Limited Companies by guarantee"),
    FormRow("CH_NONVCSE", [1, 2, 3, 4, 5, 6, 12, 13, 14], "Other CH Company Types"),
    FormRow("CH_NONVCSE", [10], None),
    FormRow("PUBLIC", [1], "Government Bodies"),
    FormRow("PUBLIC", [2], "Local Authorities"),
    FormRow("PUBLIC", [3], "NHS Organisations"),
    FormRow("NONE_VCSE", None, "Other Suppliers (VCSE)"),
    FormRow("NONE_NONVCSE", None, "Other Suppliers (Non-VCSE)"),
]


def legal_form_report(extract: DataFrame, rows: list[FormRow] = REPORT_ROWS) -> DataFrame:
    """The seven segments relabelled, grouped and put in report order.

    Forms no line asks for keep a line of their own at the end.
    """
    in_segment = Window.partitionBy("Segment").orderBy(F.col("Form").asc_nulls_last())
    placed = legal_forms(extract).withColumn("_position", F.row_number().over(in_segment))
    line, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    for number, row in reversed(list(enumerate(rows))):
        hit = F.col("Segment") == row.segment
        if row.positions is not None:
            hit = hit & F.col("_position").isin(row.positions)
        line = F.when(hit, number).otherwise(line)
        label = F.when(hit, F.lit(row.label)).otherwise(label)
    lined = (
        placed.withColumn("_line", F.coalesce(line, F.lit(len(rows))))
        .withColumn("_label", label)
        .withColumn("_place", F.when(F.col("_label").isNull(), F.col("_position")).otherwise(0))
        .withColumn("_label", F.coalesce("_label", "Form"))
    )
    report = lined.groupBy("_line", "Segment", "_place", F.col("_label").alias("LegalForm")).agg(
        F.sum("Suppliers").alias("Suppliers"), F.sum("Spending").alias("Spending")
    )
    side = F.when(F.col("Segment").isin(VCSE_SEGMENTS), "VCSE").otherwise("Non-VCSE")
    order = [ascending(c) for c in ("_line", "Segment", "_place")]
    ranked = global_rank(report, order, "RowOrder").withColumn("Side", side)
    return ranked.select("RowOrder", "Segment", "LegalForm", "Side", "Suppliers", "Spending")


def legal_form_checksum(extract: DataFrame, rows: list[FormRow] = REPORT_ROWS) -> DataFrame:
    """Suppliers and spending of the VCSE lines, the other lines and the whole."""
    return total_row(legal_form_report(extract, rows), "Side", ["Suppliers", "Spending"]).drop(
        "IsTotal"
    )
