"""The stages end to end: files in, stored datasets and report tables out.

The ledger is read once to be cleaned, once to be enriched and once to be
tallied. All tables come from the stored tally, which has one row per body and
supplier.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tallybook.operators import SortKey, ascending, descending, sort_columns
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
from tallybook.sources import read_dataset, write_csv, write_dataset

Tables = dict[str, tuple[DataFrame, list[SortKey]]]


def build_invoices(raw: DataFrame, body_codes: DataFrame, out: str) -> DataFrame:
    """Clean invoices and their supplier names, for the master to be made from."""
    write_dataset(collate.clean_ledger(raw, body_codes), f"{out}/invoices")
    invoices = read_dataset(raw.sparkSession, f"{out}/invoices")
    write_csv(collate.unique_suppliers(invoices), f"{out}/unique_suppliers")
    return invoices


def build_datasets(invoices: DataFrame, master: DataFrame, out: str) -> tuple[DataFrame, DataFrame]:
    """Enriched ledger, extract and tally, each written once.

    The extract is cut from the stored ledger, so the supplier join of the full
    ledger runs once.
    """
    spark = invoices.sparkSession
    write_dataset(enrich.enrich_ledger(invoices, master), f"{out}/combined")
    combined = read_dataset(spark, f"{out}/combined")
    write_dataset(enrich.extract_from_combined(combined), f"{out}/extract")
    write_dataset(enrich.ledger_tally(invoices, master), f"{out}/tally")
    return combined, read_dataset(spark, f"{out}/extract")


@dataclass(frozen=True)
class Choices:
    """What a report's author chooses; the defaults are those of the published report.

    ``excluded`` successor units are left out of the ranks. Without a list the
    units that miss one of their present bodies are.
    """

    excluded: list[str] | None = None
    case_ranks: list[int] = field(default_factory=lambda: bodies.CASE_STUDY_RANKS)
    successor_case_ranks: list[int] = field(
        default_factory=lambda: bodies.SUCCESSOR_CASE_STUDY_RANKS
    )
    successor_cuts: list[float] = field(default_factory=lambda: bodies.SUCCESSOR_CUTS)
    spend_cuts: list[float] = field(default_factory=lambda: suppliers.SPEND_CUTS)
    top_cut: float = suppliers.TOP_CUT
    suppliers: list[str] = field(default_factory=list)


def build_split(ledger: DataFrame, out: str) -> DataFrame:
    """Spending per body, stored: seven tables of the report derive from it."""
    write_dataset(bodies.spend_split_by_body(enrich.extract_of(ledger)), f"{out}/split", "overwrite")
    return read_dataset(ledger.sparkSession, f"{out}/split")


def report_tables(
    ledger: DataFrame,
    population: DataFrame,
    geography: DataFrame,
    shared: DataFrame,
    split: DataFrame | None = None,
    choices: Choices = Choices(),
) -> Tables:
    """Every table of the report with the order its rows are written in."""
    extract = enrich.extract_of(ledger)
    if split is None:
        split = bodies.spend_split_by_body(extract)
    per_capita = bodies.per_capita_spend(split, population)
    units = bodies.successor_rollup(per_capita, geography)
    if choices.excluded is None:
        ranked_units = bodies.complete_successor_rank(units, per_capita, geography)
    else:
        ranked_units = bodies.successor_rank(units, choices.excluded)
    by_name, by_id = [ascending("CCGName")], [ascending("ID")]
    standard = ascending(sectors.STANDARD)
    tables: Tables = {
        "bodies_covered": (quality.bodies_covered(ledger), []),
        "bad_records": (quality.bad_records(ledger), []),
        "missing_expense_totals": (quality.missing_expense_totals(ledger), []),
        "missing_by_body": (quality.missing_by_body(ledger), quality.INDICATOR_ORDER),
        "missing_concentration": (quality.missing_concentration(ledger), []),
        "ledger_totals": (quality.ledger_totals(ledger), []),
        "threshold_totals": (quality.threshold_totals(ledger), []),
        "threshold_split": (quality.threshold_split(ledger), [ascending("CCG")]),
        "named_supplier_counts": (quality.named_supplier_counts(ledger), []),
        "standard_supplier_counts": (quality.standard_supplier_counts(ledger), []),
        "extract_totals": (quality.extract_totals(ledger), []),
        "sector_split": (sectors.sector_split(extract), [ascending("SupplierSector")]),
        "public_share": (sectors.public_share(extract), []),
        "sector_pivot_by_body": (sectors.sector_pivot_by_body(extract), by_name),
        "public_share_by_body": (sectors.public_share_by_body(extract), [ascending("CCG")]),
        "gp_share_by_body": (sectors.gp_share_by_body(extract), sectors.GP_ORDER),
        "gp_share_rank": (sectors.gp_share_rank(extract), [ascending("CCG")]),
        "gp_supplier_count": (sectors.gp_supplier_count(extract), []),
        "flag_profile_nhs": (sectors.flag_profile(extract, "NHS"), []),
        "flag_profile_la": (sectors.flag_profile(extract, "LA"), []),
        "flag_profile_vcse": (sectors.flag_profile(extract, "VCSE_Status"), []),
        "supplier_crosstab_report": (
            registers.supplier_crosstab_report(extract),
            [ascending("RowOrder")],
        ),
        "spending_crosstab_report": (
            registers.spending_crosstab_report(extract),
            [ascending("RowOrder")],
        ),
        "supplier_crosstab": (registers.supplier_crosstab(extract), [ascending("Category")]),
        "spending_crosstab": (registers.spending_crosstab(extract), [ascending("Category")]),
        "unregistered_share": (registers.unregistered_share(extract), []),
        "register_counts_subset": (registers.register_counts_subset(shared, extract), []),
        "register_flags_by_body": (registers.register_flags_by_body(shared, extract), by_name),
        "legal_form_report": (registers.legal_form_report(extract), [ascending("RowOrder")]),
        "legal_form_checksum": (registers.legal_form_checksum(extract), [ascending("Side")]),
        "vcse_suppliers": (suppliers.vcse_suppliers(extract), by_id),
        "vcse_top_names": (suppliers.vcse_top_names(extract, choices.top_cut), by_id),
        "spend_bands": (suppliers.spend_bands(extract, choices.spend_cuts), [descending("Threshold")]),
        "vcse_body_counts": (suppliers.vcse_body_counts(extract), suppliers.BODY_COUNT_ORDER),
        "vcse_outliers": (suppliers.vcse_outliers(extract), [ascending("Outlier"), standard]),
        "spend_split_by_body": (split, by_id),
        "stacked_shares": (bodies.stacked_shares(split), by_id),
        "vcse_share_of_nonpublic": (bodies.vcse_share_of_nonpublic(split), by_id),
        "vcse_share_of_total": (bodies.vcse_share_of_total(split), by_id),
        "per_capita_spend": (
            bodies.case_study_flag(bodies.rank_quartile(per_capita), choices.case_ranks),
            by_id,
        ),
        "successor_rollup": (units, [descending("PercapitaSpend"), ascending("CCGCode2020")]),
        "successor_case_study": (
            bodies.successor_case_study(
                ranked_units, choices.successor_case_ranks, choices.successor_cuts
            ),
            by_id,
        ),
    }
    tables["body_names"] = (profile.body_names(ledger), by_name)
    if choices.suppliers:
        tables["supplier_by_body"] = (
            suppliers.supplier_by_body(extract, choices.suppliers),
            [standard, ascending("CCGName")],
        )
    for segment in registers.segment_conditions():
        form = "SupplierSector" if segment == "PUBLIC" else "GivenCompanyCategory"
        table = registers.legal_form_segment(extract, segment)
        tables[f"legal_form_{segment.lower()}"] = (table, [ascending(form)])
    return tables


def build_shared(extract: DataFrame, ledger: DataFrame, shared: DataFrame, out: str) -> None:
    """The extract's rows of the shared bodies, as a dataset."""
    rows = registers.shared_subset(shared, extract, enrich.extract_of(ledger))
    write_dataset(rows, f"{out}/shared", "overwrite")


def body_tables(
    ledger: DataFrame, names: list[str], places: dict[str, list[int]] | None = None
) -> Tables:
    """Supplier lists of the chosen bodies; ``places`` asks for shares of n-th suppliers."""
    extract = enrich.extract_of(ledger)
    standard = ascending(sectors.STANDARD)
    tables: Tables = {
        "gp_suppliers": (
            sectors.gp_suppliers_for_bodies(extract, names),
            [ascending("CCGName"), ascending("IsTotal"), standard],
        )
    }
    if places:
        shares = sectors.nth_supplier_share(extract, places)
        tables["nth_supplier_share"] = (shares, [ascending("CCGName")])
    for number, name in enumerate(names, 1):
        breakdown = sectors.body_supplier_breakdown(extract, name)
        tables[f"suppliers_of_body_{number}"] = (breakdown, [descending("Spending"), standard])
    return tables


def profile_tables(
    ledger: DataFrame, geography: DataFrame, names: list[str], successors: list[str]
) -> Tables:
    """Ranks of the chosen bodies and successor units among all."""
    payments, extract = enrich.payments_of(ledger), enrich.extract_of(ledger)
    of_bodies = {
        "profile_vcse_spend": profile.profile_vcse_spend(payments),
        "profile_vcse_invoice_share": profile.profile_vcse_invoice_share(payments),
        "profile_vcse_value_share": profile.profile_vcse_value_share(payments),
        "profile_supplier_share_rank": profile.profile_supplier_share_rank(payments),
        "profile_supplier_count_rank": profile.profile_supplier_count_rank(payments),
        "profile_extract_value_share": profile.profile_vcse_value_share(extract),
    }
    of_units = {
        "successor_vcse_spend": profile.successor_vcse_spend(payments, geography),
        "successor_invoice_share": profile.successor_invoice_share(payments, geography),
        "successor_value_share": profile.successor_value_share(payments, geography),
        "successor_supplier_counts": profile.successor_supplier_counts(payments, geography),
        "successor_extract_value_share": profile.successor_value_share(
            extract, geography, rank="PercentRank"
        ),
    }
    tables: Tables = {}
    for name, table in of_bodies.items():
        tables[name] = (profile.chosen(table, names), [ascending("CCGName")])
    for name, table in of_units.items():
        chosen = profile.chosen(table, successors, "CCGName2020")
        tables[name] = (chosen, [ascending("CCGName2020")])
    return tables


def write_tables(tables: Tables, out: str) -> None:
    for name, (table, order) in tables.items():
        ordered = table.orderBy(*sort_columns(order)) if order else table
        write_csv(ordered, f"{out}/{name}")


def file_report(raw: DataFrame, manifest: DataFrame | None = None) -> Tables:
    """Per-file figures and the check over all files."""
    return {
        "file_summary": (collate.file_summary(raw, manifest=manifest), [ascending("Count")]),
        "collation_check": (collate.collation_check(raw), []),
    }
