"""Every named computation as a query over the test tables.

A query is ``(spark, sf_dir) -> DataFrame``. It reads whole tables through
:class:`tallybook.testbed.Testbed`, asking only for the lookups it needs, and
returns plain types: money as double, shares rounded to nine digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.operators import head, head_and_tail
from tallybook.plans import (
    bodies,
    collate,
    enrich,
    profile,
    quality,
    registers,
    sectors,
    suppliers,
)
from tallybook.testbed import Testbed, testbed

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the computations for the test tables.
BODY = "NATION_3"
OTHER_BODY = "NATION_5"
PROFILED = ["NATION_3", "NATION_4", "NATION_5", "NATION_6"]
SUCCESSORS = ["AMERICA", "EUROPE"]
EXCLUDED = ["ASIA"]
CUTS = [40_000_000, 20_000_000, 10_000_000, 1_000_000]
TOP_CUT = 20_000_000
SUPPLIER_NAMES = ["STD#6", "STD#12"]
CASE_RANKS = [3, 8, 15, 21]
SUCCESSOR_RANKS = [2, 4]
SUCCESSOR_CUTS = [1.5, 2.5, 3.5]
OUTLIERS = [
    suppliers.OpenRange("high spend", spending_over=20e6, bodies_under=40),
    suppliers.OpenRange("mid", spending_over=9e6, spending_under=12e6, bodies_over=10, bodies_under=26),
    suppliers.OpenRange("few bodies", spending_under=2e7, bodies_over=5, bodies_under=25),
    suppliers.OpenRange("most bodies", bodies_over=24),
    suppliers.OpenRange("many bodies", spending_under=11e6, bodies_over=17, bodies_under=26),
    suppliers.OpenRange("one body", spending_under=25e6, bodies_under=2),
]
RECODE_RULES = [
    (["3", "5"], ["SUPPLIER#000000011"], "SUPPLIER#000000011 (NORTH)"),
    (["4"], ["SUPPLIER#000000011", "SUPPLIER#000000012"], "SUPPLIER#000000011 (SOUTH)"),
]


def presentable(df: DataFrame) -> DataFrame:
    """Decimals to double, doubles rounded, whole numbers to 64 bits where counted."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 9)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _raw(bed: Testbed) -> DataFrame:
    return bed.raw_ledger("body", "supplier")


def _flags(bed: Testbed) -> DataFrame:
    return collate.sign_split(collate.friendly_names(bed.raw_ledger("body", "expense", "supplier")))


def _split(bed: Testbed) -> DataFrame:
    return bodies.spend_split_by_body(bed.extract)


def _per_capita(bed: Testbed) -> DataFrame:
    return bodies.per_capita_spend(_split(bed), bed.population)


def _successors(bed: Testbed) -> DataFrame:
    return bodies.successor_rollup(_per_capita(bed), bed.geography)


def _successor_rank(bed: Testbed) -> DataFrame:
    return bodies.successor_rank(_successors(bed), EXCLUDED, "CCGName2020")


def _of_bodies(df: DataFrame) -> DataFrame:
    return profile.chosen(df, PROFILED)


def _of_successors(df: DataFrame) -> DataFrame:
    return profile.chosen(df, SUCCESSORS, "CCGName2020")


COLLATE = {
    "file_summary": lambda b: collate.file_summary(b.raw_ledger("body", "supplier", "file")),
    "collate_ledgers": lambda b: collate.friendly_names(b.raw_ledger("body", "expense", "supplier")),
    "collation_check": lambda b: collate.collation_check(_raw(b)),
    "attach_body_code": lambda b: collate.attach_body_code(
        collate.friendly_names(b.raw_ledger("body", "expense", "supplier")), b.body_codes
    ),
    "sign_split": _flags,
    "threshold_flag": lambda b: collate.threshold_flag(
        collate.friendly_names(b.raw_ledger("body", "expense", "supplier"))
    ),
    "normalise_text": lambda b: collate.normalise_text(
        collate.attach_body_code(
            collate.friendly_names(b.raw_ledger("body", "expense", "supplier")), b.body_codes
        )
    ),
    "recode_suppliers": lambda b: collate.recode_suppliers(
        b.invoices("body", "expense", "supplier"), RECODE_RULES
    ),
    "unique_suppliers": lambda b: collate.unique_suppliers(b.invoices("supplier")),
}

ENRICH = {
    "enrich_ledger": lambda b: enrich.enrich_ledger(
        b.invoices("body", "expense", "supplier"), b.suppliers
    ),
    "valid_extract": lambda b: enrich.valid_extract(
        b.invoices("body", "expense", "supplier"), b.suppliers
    ),
    "extract_summary": lambda b: enrich.extract_summary(
        enrich.valid_extract(b.invoices("supplier"), b.suppliers)
    ),
}

QUALITY = {
    "bodies_covered": lambda b: quality.bodies_covered(b.ledger),
    "bad_records": lambda b: quality.bad_records(b.ledger_without_bodies),
    "missing_expense_totals": lambda b: quality.missing_expense_totals(b.measured("expense")),
    "missing_area_by_body": lambda b: head(
        quality.missing_area_by_body(b.measured("body", "expense")), quality.AREA_ORDER, 20
    ),
    "missing_type_by_body": lambda b: head(
        quality.missing_type_by_body(b.measured("body", "expense")), quality.TYPE_ORDER, 20
    ),
    "missing_indicator": lambda b: head(
        quality.missing_by_body(b.measured("body", "expense")), quality.INDICATOR_ORDER, 25
    ),
    "missing_concentration": lambda b: quality.missing_concentration(b.measured("body", "expense")),
    "ledger_totals": lambda b: quality.ledger_totals(b.measured()),
    "threshold_totals": lambda b: quality.threshold_totals(b.measured()),
    "threshold_split": lambda b: quality.threshold_split(b.measured("body")),
    "threshold_split_ends": lambda b: head_and_tail(
        quality.threshold_split(b.measured("body")), "CCG", 22, 4
    ),
    "named_supplier_counts": lambda b: quality.named_supplier_counts(b.ledger_without_bodies),
    "standard_supplier_counts": lambda b: quality.standard_supplier_counts(
        b.ledger_without_bodies
    ),
    "extract_totals": lambda b: quality.extract_totals(b.ledger),
}

SECTORS = {
    "sector_split": lambda b: sectors.sector_split(b.extract_without_bodies),
    "public_share": lambda b: sectors.public_share(b.extract_without_bodies),
    "sector_pivot_by_body": lambda b: sectors.sector_pivot_by_body(b.extract),
    "public_share_by_body": lambda b: sectors.public_share_by_body(b.extract),
    "body_supplier_breakdown": lambda b: sectors.body_supplier_breakdown(b.extract, BODY),
    "nth_supplier_share": lambda b: sectors.nth_supplier_share(
        b.extract, {BODY: [2, 3, 7], OTHER_BODY: [1]}
    ),
    "gp_share_by_body": lambda b: sectors.gp_share_by_body(b.extract),
    "gp_supplier_count": lambda b: sectors.gp_supplier_count(b.extract_without_bodies),
    "gp_share_rank": lambda b: sectors.gp_share_rank(b.extract),
    "gp_suppliers_for_body": lambda b: sectors.gp_suppliers_for_bodies(
        b.extract, [*PROFILED, "NATION_7"]
    ),
    "flag_profile_nhs": lambda b: sectors.flag_profile(b.extract_without_bodies, "NHS"),
    "flag_profile_la": lambda b: sectors.flag_profile(b.extract_without_bodies, "LA"),
    "flag_profile_vcse": lambda b: sectors.flag_profile(b.extract_without_bodies, "VCSE_Status"),
}

REGISTERS = {
    "supplier_crosstab": lambda b: registers.supplier_crosstab(b.extract_without_bodies),
    "supplier_crosstab_report": lambda b: registers.supplier_crosstab_report(
        b.extract_without_bodies
    ),
    "spending_crosstab": lambda b: registers.spending_crosstab(b.extract_without_bodies),
    "spending_crosstab_report": lambda b: registers.spending_crosstab_report(
        b.extract_without_bodies
    ),
    "unregistered_share": lambda b: registers.unregistered_share(b.extract_without_bodies),
    "shared_subset": lambda b: registers.shared_subset(
        b.shared_list,
        enrich.valid_extract(b.invoices("body", "expense", "supplier"), b.suppliers),
    ),
    "register_counts_subset": lambda b: registers.register_counts_subset(b.shared_list, b.extract),
    "register_flags_by_body": lambda b: registers.register_flags_by_body(b.shared_list, b.extract),
    "legal_form_cc_ch": lambda b: registers.legal_form_segment(b.extract_without_bodies, "CC_CH"),
    "legal_form_cc_only": lambda b: registers.legal_form_segment(
        b.extract_without_bodies, "CC_ONLY"
    ),
    "legal_form_ch_vcse": lambda b: registers.legal_form_segment(
        b.extract_without_bodies, "CH_VCSE"
    ),
    "legal_form_ch_nonvcse": lambda b: registers.legal_form_segment(
        b.extract_without_bodies, "CH_NONVCSE"
    ),
    "legal_form_public": lambda b: registers.legal_form_segment(
        b.extract_without_bodies, "PUBLIC"
    ),
    "legal_form_none_vcse": lambda b: registers.legal_form_segment(
        b.extract_without_bodies, "NONE_VCSE"
    ),
    "legal_form_none_nonvcse": lambda b: registers.legal_form_segment(
        b.extract_without_bodies, "NONE_NONVCSE"
    ),
    "legal_form_report": lambda b: registers.legal_form_report(b.extract_without_bodies),
    "legal_form_checksum": lambda b: registers.legal_form_checksum(b.extract_without_bodies),
}

SUPPLIERS = {
    "vcse_suppliers": lambda b: suppliers.vcse_suppliers(b.extract_without_bodies),
    "spend_bands": lambda b: suppliers.spend_bands(b.extract_without_bodies, CUTS),
    "vcse_top_names": lambda b: suppliers.vcse_top_names(b.extract_without_bodies, TOP_CUT),
    "vcse_body_counts": lambda b: suppliers.vcse_body_counts(b.extract),
    "vcse_outliers": lambda b: suppliers.vcse_outliers(b.extract, OUTLIERS),
    "supplier_by_body": lambda b: suppliers.supplier_by_body(b.extract, SUPPLIER_NAMES),
}

BODIES = {
    "spend_split_by_body": _split,
    "stacked_shares": lambda b: bodies.stacked_shares(_split(b)),
    "vcse_share_of_nonpublic": lambda b: bodies.vcse_share_of_nonpublic(_split(b)),
    "vcse_share_of_total": lambda b: bodies.vcse_share_of_total(_split(b)),
    "per_capita_spend": _per_capita,
    "case_study_flag": lambda b: bodies.case_study_flag(_per_capita(b), CASE_RANKS),
    "rank_quartile": lambda b: bodies.rank_quartile(_per_capita(b)),
    "successor_rollup": _successors,
    "successor_rank": _successor_rank,
    "complete_successor_rank": lambda b: bodies.complete_successor_rank(
        _successors(b), b.extract.select("CCGCode").distinct(), b.geography
    ),
    "successor_case_study": lambda b: bodies.successor_case_study(
        _successor_rank(b), SUCCESSOR_RANKS, SUCCESSOR_CUTS
    ),
}

PROFILE = {
    "profile_vcse_spend": lambda b: _of_bodies(profile.profile_vcse_spend(b.payments)),
    "profile_vcse_invoice_share": lambda b: _of_bodies(
        profile.profile_vcse_invoice_share(b.payments)
    ),
    "profile_vcse_value_share": lambda b: _of_bodies(profile.profile_vcse_value_share(b.payments)),
    "profile_supplier_counts": lambda b: _of_bodies(profile.profile_supplier_counts(b.payments)),
    "profile_supplier_share_rank": lambda b: _of_bodies(
        profile.profile_supplier_share_rank(b.payments)
    ),
    "profile_supplier_count_rank": lambda b: _of_bodies(
        profile.profile_supplier_count_rank(b.payments)
    ),
    "profile_extract_value_share": lambda b: _of_bodies(
        profile.profile_vcse_value_share(b.extract)
    ),
    "successor_vcse_spend": lambda b: _of_successors(
        profile.successor_vcse_spend(b.payments, b.geography, EXCLUDED)
    ),
    "successor_invoice_share": lambda b: _of_successors(
        profile.successor_invoice_share(b.payments, b.geography, EXCLUDED)
    ),
    "successor_value_share": lambda b: _of_successors(
        profile.successor_value_share(b.payments, b.geography, EXCLUDED)
    ),
    "successor_supplier_counts": lambda b: _of_successors(
        profile.successor_supplier_counts(b.payments, b.geography, EXCLUDED)
    ),
    "successor_extract_value_share": lambda b: _of_successors(
        profile.successor_value_share(b.extract, b.geography, EXCLUDED, "PercentRank")
    ),
    "body_names": lambda b: profile.body_names(b.invoices("body")),
}


def _query(build: Callable[[Testbed], DataFrame]) -> Query:
    return lambda spark, sf_dir: presentable(build(testbed(spark, sf_dir)))


def queries() -> dict[str, Query]:
    groups = [COLLATE, ENRICH, QUALITY, SECTORS, REGISTERS, SUPPLIERS, BODIES, PROFILE]
    return {name: _query(build) for group in groups for name, build in group.items()}
