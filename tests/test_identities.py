"""Properties that hold on any ledger, checked on random ones."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from frames import invoices, master
from pyspark.sql import functions as F

from tallybook.plans import bodies, enrich, profile, quality, registers, sectors, suppliers
from tallybook.schemas import SECTORS

HOT = "S0"


def _random_case(spark, seed: int):
    pick = random.Random(seed)
    names = [f"S{i}" for i in range(40)]
    rows = []
    for _ in range(3000):
        # One supplier and one body hold a third of the rows each.
        name = HOT if pick.random() < 0.34 else pick.choice([*names, None])
        body = 0 if pick.random() < 0.34 else pick.randrange(9)
        amount = Decimal(pick.randrange(-3_000_000, 9_000_000)) / 100
        rows.append((f"B{body}", f"E{body}", name, amount))
    known = []
    for i, name in enumerate(names):
        sector = pick.choice(SECTORS)
        public = sector in ("NHS", "LA", "GOV")
        charity = int(not public and pick.random() < 0.4)
        company = int(pick.random() < 0.5)
        status = {(1, 1): "CC&CH", (1, 0): "CCnotCH", (0, 1): "CHnotCC", (0, 0): "NotCCorCH"}
        known.append(
            {
                "Supplier": name,
                "SUPPLIER_STANDARD_NAME": name,
                "SupplierSector": sector,
                "NHS": int(sector == "NHS"),
                "LA": int(sector == "LA"),
                "GOV": int(sector == "GOV"),
                "GPServices": int(sector == "GPServices"),
                "CCFound": charity,
                "CHFound": company,
                "CCCH_Status": status[charity, company],
                "VCSE_Status": int(charity or (not public and pick.random() < 0.3)),
                "GivenCompanyCategory": f"F{i % 5}",
                "Redacted": int(i % 11 == 3),
            }
        )
    return invoices(spark, rows), master(spark, known)


@pytest.fixture(scope="module", params=[1, 2])
def case(request, spark):
    ledger, known = _random_case(spark, request.param)
    return ledger.cache(), known.cache()


def test_income_and_spending_make_the_amount(case):
    ledger, _ = case
    assert ledger.filter(F.col("Income") + F.col("Spending") != F.col("Amount")).count() == 0


def test_spend_split_adds_up(case):
    split = bodies.spend_split_by_body(enrich.extract_tally(*case))
    total = F.col("NHSLASpend") + F.col("NonNHSLASpend")
    inner = F.col("NonNHSLAVCSESpend") + F.col("NonNHSLANonVCSESpend")
    assert split.filter((total != F.col("TotalSpend")) | (inner != F.col("NonNHSLASpend"))).count() == 0
    ids = [r["ID"] for r in split.select("ID").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))


def test_pivot_total_is_the_body_total(case):
    extract = enrich.extract_tally(*case)
    wide = {r["CCGName"]: r["Total"] for r in sectors.sector_pivot_by_body(extract).collect()}
    want = {r[0]: r[1] for r in extract.groupBy("CCGName").agg(F.sum("Spending")).collect()}
    assert wide == want


def test_sector_shares_sum_to_one(case):
    row = sectors.sector_split(enrich.extract_tally(*case)).agg(
        F.sum("PercentInvoices"), F.sum("PercentExpenditure")
    ).collect()[0]
    assert row[0] == pytest.approx(1) and row[1] == pytest.approx(1)


def test_segments_cover_all_suppliers_once(case):
    extract = enrich.extract_tally(*case)
    forms = registers.legal_forms(extract).agg(F.sum("Suppliers"), F.sum("Spending")).collect()[0]
    whole = extract.agg(F.count_distinct("SUPPLIER_STANDARD_NAME"), F.sum("Spending")).collect()[0]
    assert tuple(forms) == tuple(whole)
    sums = {r["Side"]: r for r in registers.legal_form_checksum(extract).collect()}
    vcse = sectors.flag_profile(extract, "VCSE_Status").collect()[0]
    assert sums["Total"]["Suppliers"] == whole[0]
    assert sums["VCSE"]["Suppliers"] == vcse["Suppliers"]
    assert sums["VCSE"]["Spending"] == vcse["Spending"]


def test_bands_are_nested(case):
    cuts = [3_000_000, 1_000_000, 100_000, 0]
    bands = suppliers.spend_bands(enrich.extract_tally(*case), cuts).collect()
    counts = {r["Threshold"]: r["Suppliers"] for r in bands}
    assert [counts[c] for c in cuts] == sorted(counts[c] for c in cuts)
    assert {r["Threshold"]: r["ShareOfSpending"] for r in bands}[0] == pytest.approx(1)


def test_nested_counts_shrink(case):
    row = quality.named_supplier_counts(enrich.ledger_tally(*case)).collect()[0]
    assert row["InLedger"] >= row["Payments"] >= row["OverThreshold"] >= row["InExtract"] > 0


def test_top_names_keep_their_rank(case):
    extract = enrich.extract_tally(*case)
    ranks = {r[1]: r[0] for r in suppliers.vcse_suppliers(extract).collect()}
    top = suppliers.vcse_top_names(extract, 400_000).collect()
    assert top and all(ranks[r[1]] == r[0] for r in top)


def test_both_tally_shapes_agree(spark, case):
    def figures():
        ledger, extract = enrich.ledger_tally(*case), enrich.extract_tally(*case)
        frames = [
            quality.extract_totals(ledger),
            quality.bodies_covered(ledger),
            bodies.spend_split_by_body(extract),
            suppliers.vcse_body_counts(extract),
            registers.supplier_crosstab(extract),
        ]
        return [sorted(map(str, f.collect())) for f in frames]

    joined_first = figures()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = enrich.extract_tally(*case)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" in plan.split("Join")[1]
        assert figures() == joined_first
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_tally_gives_the_same_figures(case):
    """One row per body and supplier instead of one per invoice."""
    stored = enrich.ledger_tally(*case).cache()
    assert stored.count() == stored.select(*enrich.BODY, "Supplier").distinct().count()
    pairs = [
        (quality.ledger_totals, enrich.ledger_tally(*case), stored),
        (quality.threshold_split, enrich.ledger_tally(*case), stored),
        (quality.missing_by_body, enrich.ledger_tally(*case), stored),
        (quality.extract_totals, enrich.ledger_tally(*case), stored),
        (bodies.spend_split_by_body, enrich.extract_tally(*case), enrich.extract_of(stored)),
        (suppliers.vcse_suppliers, enrich.extract_tally(*case), enrich.extract_of(stored)),
        (registers.legal_form_report, enrich.extract_tally(*case), enrich.extract_of(stored)),
        (profile.profile_vcse_spend, enrich.payments_tally(*case), enrich.payments_of(stored)),
        (profile.profile_supplier_counts, enrich.payments_tally(*case), enrich.payments_of(stored)),
        (profile.profile_vcse_value_share, enrich.payments_tally(*case), enrich.payments_of(stored)),
    ]
    for figure, live, kept in pairs:
        assert sorted(map(str, figure(live).collect())) == sorted(map(str, figure(kept).collect()))
