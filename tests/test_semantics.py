"""One small ledger per NULL, tie, threshold and join rule."""

from __future__ import annotations

from decimal import Decimal

import pytest
from frames import frame, invoices, master, tuples
from pyspark.sql import functions as F

from tallybook.functions import distinct_with_null, ratio, strict_sum
from tallybook.operators import ascending, descending, global_rank
from tallybook.plans import bodies, collate, enrich, profile, quality, registers, sectors


def test_missing_amount_leaves_flags_unknown(spark):
    got = tuples(
        invoices(spark, [("A", "1", "S", None)]),
        "PositiveFlag",
        "Income",
        "Spending",
        "InvoiceOver25k",
    )
    assert got == [(None, None, None, None)]


def test_zero_is_income(spark):
    got = tuples(invoices(spark, [("A", "1", "S", 0)]), "PositiveFlag", "Income", "Spending")
    assert got == [(0, Decimal("0.00"), Decimal("0.00"))]


def test_negative_is_income(spark):
    got = tuples(invoices(spark, [("A", "1", "S", -5)]), "PositiveFlag", "Income", "Spending")
    assert got == [(0, Decimal("-5.00"), Decimal("0.00"))]


def test_threshold_is_inclusive(spark):
    got = tuples(
        invoices(spark, [("A", "1", "S", "24999.99"), ("A", "1", "S", "25000.00")]).orderBy(
            "Amount"
        ),
        "InvoiceOver25k",
    )
    assert got == [(0,), (1,)]


def test_strict_sum_is_null_with_a_null(spark):
    df = frame(spark, "k string, x int", [("a", 1), ("a", None), ("b", 2), ("b", 3)])
    got = dict(tuples(df.groupBy("k").agg(strict_sum("x"))))
    assert got == {"a": None, "b": 5}


def test_null_is_one_distinct_value(spark):
    df = frame(spark, "x string", [("a",), ("a",), (None,), (None,)])
    assert tuples(df.agg(distinct_with_null("x"))) == [(2,)]
    kept = frame(spark, "x string, k int", [("a", 1), ("b", 0), (None, 0)])
    assert tuples(kept.agg(distinct_with_null("x", F.col("k") == 1))) == [(1,)]


def test_unknown_validity_is_not_in_the_extract(spark):
    ledger = invoices(spark, [("A", "1", "S", 30000), ("A", "1", "T", 30000)])
    known = master(spark, [{"Supplier": "S"}, {"Supplier": "T", "Redacted": None}])
    assert tuples(enrich.valid_extract(ledger, known), "Supplier") == [("S",)]
    assert tuples(
        enrich.extract_from_combined(enrich.enrich_ledger(ledger, known)), "Supplier"
    ) == [("S",)]


def test_missing_values_sort_last_both_ways(spark):
    df = frame(spark, "k string, x int", [("a", None), ("b", 1), ("c", 2)])
    up = global_rank(df, [ascending("x"), ascending("k")], "r")
    down = global_rank(df, [descending("x"), ascending("k")], "r")
    assert dict(tuples(up, "k", "r")) == {"b": 1, "c": 2, "a": 3}
    assert dict(tuples(down, "k", "r")) == {"c": 1, "b": 2, "a": 3}


def test_equal_shares_rank_alphabetically(spark):
    ledger = invoices(
        spark,
        [("B", "2", "S", 30000), ("A", "1", "S", 30000), ("C", "3", "S", 10), ("C", "3", "S", 30000)],
    )
    got = tuples(quality.threshold_split(enrich.measured(ledger)).orderBy("CCG"), "CCGName", "CCG", "PercentOver")
    assert got == [("A", 1, 1.0), ("B", 2, 1.0), ("C", 3, 0.5)]


def test_second_rank_keeps_the_first_on_ties(spark):
    ledger = invoices(
        spark, [("A", "1", "S", 10), ("B", "2", "S", 10), ("B", "2", "S", 10), ("C", "3", "S", 10)]
    )
    payments = enrich.payments_tally(ledger, master(spark, [{"Supplier": "S", "VCSE_Status": 1}]))
    got = tuples(
        profile.profile_vcse_spend(payments),
        "CCGName",
        "VCSESpendRank",
        "VCSEPerTransactionRank",
    )
    # B spends most; all spend the same per transaction, so B stays first.
    assert sorted(got) == [("A", 2, 2), ("B", 1, 1), ("C", 3, 3)]


def test_division_by_zero_is_null(spark):
    df = frame(spark, "a int, b int", [(1, 0), (0, 0), (1, 2), (1, None)])
    assert [r[0] for r in tuples(df.select(ratio("a", "b")))] == [None, None, 0.5, None]


def test_repeated_key_in_the_master_fails(spark):
    ledger = invoices(spark, [("A", "1", "S", 30000)])
    doubled = master(spark, [{"Supplier": "S"}, {"Supplier": "S"}])
    with pytest.raises(Exception, match="repeated"):
        enrich.enrich_ledger(ledger, doubled).collect()


def test_unnamed_payment_matches_unnamed_master_row(spark):
    ledger = invoices(spark, [("A", "1", None, 10), ("A", "1", "X", 10)])
    known = master(spark, [{"Supplier": None, "SUPPLIER_STANDARD_NAME": None, "NHS": 1}])
    got = tuples(enrich.enrich_ledger(ledger, known), "Supplier", "NHS")
    assert sorted(got, key=str) == [("X", None), (None, 1)]


def test_enrichment_keeps_every_row(spark):
    ledger = invoices(spark, [("A", "1", s, 10) for s in ["S", "S", "T", None, "U"]])
    assert enrich.enrich_ledger(ledger, master(spark, [{"Supplier": "S"}])).count() == 5


def test_body_code_is_found_by_local_name(spark):
    codes = frame(
        spark,
        "FID int, CCG18CD string, CCG18CDH string, CCG18NM string, OurNames string",
        [(1, "E1", "X", "NHS Bath and Somerset CCG", "NHS Bath & Somerset CCG")],
    )
    raw = frame(
        spark,
        "CCGName string, Amount int",
        [("NHS Bath & Somerset CCG", 1), ("NHS Bath and Somerset CCG", 2)],
    )
    got = dict(tuples(collate.attach_body_code(raw, codes), "Amount", "CCGCode"))
    assert got == {1: "E1", 2: None}


@pytest.mark.parametrize(
    "code, supplier, expected",
    [
        ("E38000101", "ST JOSEPHS HOSPICE", "ST JOSEPHS HOSPICE (LIVERPOOL)"),
        ("E38000088", "ST JOSEPHS HOSPICE", "ST JOSEPHS HOSPICE (HACKNEY)"),
        ("E38000073", "ST MICHAEL'S HOSPICE", "ST MICHAELS HOSPICE (HARROGATE)"),
        ("E38000078", "ST MICHAELS HOSPICE", "ST MICHAEL'S HOSPICE (HEREFORDSHIRE)"),
        ("E38000076", "ST JOSEPHS HOSPICE", "ST JOSEPHS HOSPICE"),
        ("E38000999", "ST MICHAELS HOSPICE", "ST MICHAELS HOSPICE"),
        (None, "ST JOSEPHS HOSPICE", None),
        (None, "OTHER", "OTHER"),
        ("E38000101", None, None),
    ],
)
def test_supplier_recoding(spark, code, supplier, expected):
    df = frame(spark, "CCGCode string, Supplier string", [(code, supplier)])
    assert tuples(collate.recode_suppliers(df), "Supplier") == [(expected,)]


def test_body_without_gp_spending_keeps_null(spark):
    ledger = invoices(spark, [("A", "1", "G", 30000), ("A", "1", "S", 30000), ("B", "2", "S", 30000)])
    extract = enrich.extract_tally(
        ledger, master(spark, [{"Supplier": "G", "GPServices": 1}, {"Supplier": "S"}])
    )
    got = tuples(
        sectors.gp_share_by_body(extract).orderBy("CCGName"), "CCGName", "CCGCode", "GPSpend",
        "Percent_GPSpend",
    )
    assert got == [("A", "1", Decimal("30000.00"), 0.5), ("B", None, None, None)]
    ranks = tuples(sectors.gp_share_rank(extract), "CCGName", "CCG")
    assert sorted(ranks) == [("A", 1), ("B", 2)]


def test_missing_pivot_cell_is_zero(spark):
    ledger = invoices(spark, [("A", "1", "N", 30000), ("A", "1", "L", 50000), ("B", "2", "N", 40000)])
    extract = enrich.extract_tally(
        ledger,
        master(
            spark,
            [
                {"Supplier": "N", "SupplierSector": "NHS", "NHS": 1},
                {"Supplier": "L", "SupplierSector": "LA", "LA": 1},
            ],
        ),
    )
    got = tuples(
        sectors.sector_pivot_by_body(extract).orderBy("CCGName"),
        "CCGName", "NHS", "LA", "School", "Total", "PC_NHS", "PC_School",
    )
    assert got == [
        ("A", Decimal(30000), Decimal(50000), Decimal(0), Decimal(80000), 0.375, 0.0),
        ("B", Decimal(40000), Decimal(0), Decimal(0), Decimal(40000), 1.0, 0.0),
    ]


def test_unknown_vcse_flag_makes_the_body_share_unknown(spark):
    ledger = invoices(spark, [("A", "1", "S", 10), ("A", "1", "X", 10), ("B", "2", "S", 10)])
    payments = enrich.payments_tally(ledger, master(spark, [{"Supplier": "S", "VCSE_Status": 1}]))
    got = tuples(
        profile.profile_vcse_invoice_share(payments), "CCGName", "TotInvoices", "VCSEInvoices", "Rank"
    )
    assert sorted(got) == [("A", 2, None, 2), ("B", 1, 1, 1)]


def test_body_without_vcse_suppliers_keeps_null_counts(spark):
    ledger = invoices(spark, [("A", "1", "S", 10), ("A", "1", "T", 10), ("B", "2", "T", 10)])
    payments = enrich.payments_tally(
        ledger, master(spark, [{"Supplier": "S", "VCSE_Status": 1}, {"Supplier": "T"}])
    )
    got = tuples(
        profile.profile_supplier_counts(payments),
        "CCGName", "CountSuppliers", "CountVCSESuppliers", "ValueVCSESuppliers",
    )
    assert sorted(got) == [("A", 2, 1, Decimal("10.00")), ("B", 1, None, None)]


LOOKUP = (
    "CCGCode2018 string, CCGCode2020 string, CCGName2020 string",
    [("1", "N1", "North"), ("2", "N1", "North"), ("3", "S1", "South"), ("4", "S1", "South")],
)


def test_successor_counts_add_up_bodies(spark):
    """A supplier paid by two merged bodies counts twice."""
    ledger = invoices(spark, [("A", "1", "S", 10), ("B", "2", "S", 10), ("C", "3", "S", 10)])
    payments = enrich.payments_tally(ledger, master(spark, [{"Supplier": "S", "VCSE_Status": 1}]))
    got = tuples(
        profile.successor_supplier_counts(payments, frame(spark, *LOOKUP), []),
        "CCGName2020", "CountSuppliers", "CountRank",
    )
    assert sorted(got) == [("North", 2, 1), ("South", 1, 2)]


def test_successor_with_a_missing_component_is_dropped(spark):
    ledger = invoices(spark, [("A", "1", "S", 30000), ("B", "2", "S", 30000), ("C", "3", "S", 90000)])
    extract = enrich.extract_tally(ledger, master(spark, [{"Supplier": "S", "VCSE_Status": 1}]))
    people = frame(spark, "CCGCode string, Mid2018Pop bigint", [("1", 100), ("2", 200), ("3", 50)])
    lookup = frame(spark, *LOOKUP)
    per_capita = bodies.per_capita_spend(bodies.spend_split_by_body(extract), people)
    units = bodies.successor_rollup(per_capita, lookup)
    every = tuples(units.orderBy("CCGCode2020"), "CCGCode2020", "Population", "PercapitaSpend")
    assert every == [("N1", 300, 200.0), ("S1", 50, 1800.0)]
    derived = tuples(bodies.complete_successor_rank(units, per_capita, lookup), "CCGCode2020", "ID")
    assert derived == [("N1", 1)]
    assert tuples(bodies.successor_rank(units, ["S1"]), "CCGCode2020", "ID") == [("N1", 1)]


def test_missing_population_is_unknown_per_capita(spark):
    ledger = invoices(spark, [("A", "1", "S", 30000), ("B", "2", "S", 30000)])
    extract = enrich.extract_tally(ledger, master(spark, [{"Supplier": "S", "VCSE_Status": 1}]))
    people = frame(spark, "CCGCode string, Mid2018Pop bigint", [("2", 200)])
    per_capita = bodies.per_capita_spend(bodies.spend_split_by_body(extract), people)
    got = tuples(per_capita, "CCGName", "PerCapitaVCSESpend", "ID")
    assert sorted(got) == [("A", None, 2), ("B", 150.0, 1)]
    units = bodies.successor_rollup(per_capita, frame(spark, *LOOKUP))
    assert tuples(units, "CCGCode2020", "Population", "PercapitaSpend") == [("N1", None, None)]


def test_listed_body_without_rows_gives_one_empty_row(spark):
    ledger = invoices(spark, [("A", "1", "S", 30000), ("A", "1", "S", 40000), ("C", "3", "S", 30000)])
    known = master(spark, [{"Supplier": "S", "CCFound": 1, "CHFound": 0}])
    shared = frame(spark, "CCGName string", [("A",), ("B",)])
    subset = registers.shared_subset(shared, enrich.valid_extract(ledger, known))
    assert sorted(tuples(subset, "CCGName", "Supplier", "CCFound"), key=str) == [
        ("A", "S", 1), ("A", "S", 1), ("B", None, None),
    ]
    extract = enrich.extract_tally(ledger, known)
    flags = tuples(registers.register_flags_by_body(shared, extract), "CCGName", "Charities", "Companies")
    assert sorted(flags) == [("A", 2, 0), ("B", None, None)]
    assert tuples(registers.register_counts_subset(shared, extract)) == [(1, 0)]


def test_attributes_come_from_the_first_raw_name(spark):
    ledger = invoices(spark, [("A", "1", "S2", 30000), ("A", "1", "S1", 30000), ("A", "1", "S2", 30000)])
    known = master(
        spark,
        [
            {"Supplier": "S1", "SUPPLIER_STANDARD_NAME": "S", "SupplierSector": "School"},
            {"Supplier": "S2", "SUPPLIER_STANDARD_NAME": "S", "SupplierSector": "NHS"},
        ],
    )
    table = registers.supplier_crosstab(enrich.extract_tally(ledger, known))
    assert tuples(table, "SupplierSector", "NotCCorCH", "Total", "Category") == [
        ("School", 1, 1, "Categorised Other")
    ]


def test_overlapping_segments_count_in_both(spark):
    """A charity and company that is also a public body meets two of the filters."""
    ledger = invoices(spark, [("A", "1", "S", 30000)])
    known = master(
        spark,
        [{"Supplier": "S", "CCFound": 1, "CHFound": 1, "GOV": 1, "SupplierSector": "GOV",
          "GivenCompanyCategory": "F"}],
    )
    extract = enrich.extract_tally(ledger, known)
    got = tuples(registers.legal_forms(extract), "Segment", "Form", "Suppliers")
    assert sorted(got) == [("CC_CH", "F", 1), ("PUBLIC", "GOV", 1)]
    assert tuples(registers.legal_form_segment(extract, "PUBLIC"), "SupplierSector") == [("GOV",)]


def test_report_lines_follow_the_places_of_forms(spark):
    names = [f"F{i}" for i in range(1, 10)]
    ledger = invoices(spark, [("A", "1", n, 30000) for n in names])
    known = master(
        spark,
        [{"Supplier": n, "CCFound": 1, "CHFound": 1, "GivenCompanyCategory": n} for n in names],
    )
    report = registers.legal_form_report(enrich.extract_tally(ledger, known))
    got = tuples(report.orderBy("RowOrder"), "RowOrder", "LegalForm", "Suppliers")
    # The ninth form has no line of its own in the layout and is kept at the end.
    assert got == [
        (1, "F1", 1),
        (2, "Private Limited Companies by guarantee", 5),
        (3, "Other Company Types", 2),
        (4, "F9", 1),
    ]
    sums = tuples(registers.legal_form_checksum(enrich.extract_tally(ledger, known)), "Side", "Suppliers")
    assert sorted(sums) == [("Total", 9), ("VCSE", 9)]


def test_file_summary_counts_unnamed_suppliers_and_strict_amounts(spark):
    raw = frame(
        spark,
        "File string, Entity string, Supplier string, `AP Amount (£)` decimal(18,2)",
        [
            ("f1", "B", "s", Decimal("1.50")),
            ("f1", "A", None, Decimal("2.00")),
            ("f1", None, "s", Decimal("3.00")),
            ("f2", "C", "t", None),
            ("f2", "C", "t", Decimal("1.00")),
        ],
    )
    got = tuples(
        collate.file_summary(raw).orderBy("Count"),
        "Count", "File", "CCG", "Suppliers", "Invoices", "Amount",
    )
    assert got == [(1, "f1", "A", 2, 3, Decimal("6.50")), (2, "f2", "C", 1, 2, None)]
    check = tuples(collate.collation_check(raw), "Bodies", "Records", "NetAmount")
    assert check == [(4, 5, None)]


def test_totals_are_unknown_with_an_unknown_amount(spark):
    known = enrich.measured(invoices(spark, [("A", "1", "S", 30000), ("A", "1", "S", -10)]))
    assert tuples(quality.ledger_totals(known)) == [
        (2, 1, Decimal("30000.00"), 1, Decimal("-10.00"))
    ]
    unknown = enrich.measured(invoices(spark, [("A", "1", "S", 30000), ("A", "1", "S", None)]))
    assert tuples(quality.ledger_totals(unknown)) == [(2, None, None, None, None)]
    over = tuples(quality.threshold_totals(unknown), "OverInvoices", "ShareOfPayments")
    assert over == [(1, None)]


def test_n_th_suppliers_of_several_bodies(spark):
    ledger = invoices(
        spark,
        [("A", "1", "S", 50000), ("A", "1", "T", 30000), ("A", "1", "U", 20000 + 5000),
         ("B", "2", "S", 40000), ("C", "3", "S", 90000)],
    )
    extract = enrich.extract_tally(ledger, master(spark, [{"Supplier": s} for s in "STU"]))
    got = dict(tuples(sectors.nth_supplier_share(extract, {"A": [2, 3], "B": [1, 2]})))
    # B has one supplier; a share with a second one is unknown.
    assert got == {"A": pytest.approx(55 / 105), "B": None}
