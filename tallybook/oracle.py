"""The named computations as SQL, written apart from the Spark plans.

Each statement starts from the same base: ledger rows, supplier master, their
join, and the extract. The statements follow the definitions step by step
(filter, group, join, sort) where the Spark plans fold steps together. A total
over no rows is 0, as in the definitions, where SQL alone would say NULL.
"""

from __future__ import annotations

BASE = """
WITH raw AS (
  SELECT o.o_orderpriority AS File,
         lower(n.n_name) AS Entity,
         lower(nullif(p.p_type, 'PROMO')) AS RawType,
         lower(nullif(p.p_brand, 'Brand#7')) AS RawArea,
         CASE WHEN l.l_suppkey % 50 = 7 THEN NULL ELSE s.s_name END AS RawSupplier,
         CAST(CASE WHEN l.l_returnflag = 'R' THEN -l.l_extendedprice
                   ELSE l.l_extendedprice END AS DECIMAL(18,2)) AS Amount
  FROM lineitem l
  LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN part p ON p.p_partkey = l.l_partkey
  LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
), coded AS (
  SELECT r.*, CAST(n.n_nationkey AS VARCHAR) AS RawCode
  FROM raw r LEFT JOIN nation n ON lower(n.n_name) = r.Entity
), invoices AS (
  SELECT upper(Entity) AS CCGName, upper(RawCode) AS CCGCode, upper(RawType) AS ExpenseType,
         upper(RawArea) AS ExpenseArea, upper(RawSupplier) AS Supplier, Amount,
         CAST(Amount > 0 AS INTEGER) AS PositiveFlag,
         CASE WHEN Amount <= 0 THEN Amount WHEN Amount > 0 THEN 0 END AS Income,
         CASE WHEN Amount > 0 THEN Amount WHEN Amount <= 0 THEN 0 END AS Spending,
         CAST(Amount >= 25000 AS INTEGER) AS InvoiceOver25k
  FROM coded
), keyed AS (
  SELECT upper(s_name) AS Supplier, s_suppkey AS k, s_suppkey // 2 AS j,
         split_part('CareHome,Executor,GOV,GPServices,Hospice,LA,LMC_LPC,NHS,Other,PharmOp,'
                    || 'PoliceFire,School,Solicitor,University', ',',
                    CAST((s_suppkey // 2) % 14 + 1 AS INTEGER)) AS sector
  FROM supplier WHERE s_suppkey % 50 <> 7
), registered AS (
  SELECT *, sector NOT IN ('NHS', 'LA', 'GOV') AS private,
         CAST(j % 3 = 0 AND sector NOT IN ('NHS', 'LA', 'GOV') AS INTEGER) AS CCFound,
         CAST(j % 2 = 0 AS INTEGER) AS CHFound
  FROM keyed
), master AS (
  SELECT Supplier, 'STD#' || j AS SUPPLIER_STANDARD_NAME,
         CAST(k % 23 = 5 AS INTEGER) AS Redacted, CAST(k % 29 = 6 AS INTEGER) AS PHB_CHC,
         CAST(k % 31 = 8 AS INTEGER) AS Uninformative, sector AS SupplierSector,
         CASE WHEN CCFound = 1 AND CHFound = 1 THEN 'CC&CH' WHEN CCFound = 1 THEN 'CCnotCH'
              WHEN CHFound = 1 THEN 'CHnotCC' ELSE 'NotCCorCH' END AS CCCH_Status,
         'FORM_' || (j % 4) AS GivenCompanyCategory, CCFound, CHFound,
         CAST(sector = 'NHS' AS INTEGER) AS NHS, CAST(sector = 'LA' AS INTEGER) AS LA,
         CAST(sector = 'GOV' AS INTEGER) AS GOV,
         CAST(sector = 'GPServices' AS INTEGER) AS GPServices,
         CAST((CCFound = 1 OR j % 5 = 1) AND private AS INTEGER) AS VCSE_Status
  FROM registered
  UNION ALL
  SELECT NULL, NULL, 1, 0, 0, NULL, NULL, NULL, 0, 0, 0, 0, 0, 0, 0
), combined AS (
  SELECT i.*, m.* EXCLUDE (Supplier)
  FROM invoices i LEFT JOIN master m ON m.Supplier IS NOT DISTINCT FROM i.Supplier
), extract AS (
  SELECT * EXCLUDE (Redacted, PHB_CHC, Uninformative) FROM combined
  WHERE InvoiceOver25k = 1 AND Supplier IS NOT NULL
    AND Redacted = 0 AND PHB_CHC = 0 AND Uninformative = 0
), population AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS CCGCode, count(*) * 1000 AS Mid2018Pop
  FROM customer GROUP BY ALL
), geography AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS CCGCode, CAST(n_regionkey AS VARCHAR) AS CCGCode2020,
         r_name AS CCGName2020
  FROM nation LEFT JOIN region ON r_regionkey = n_regionkey
), shared AS (
  SELECT n_name AS CCGName FROM nation WHERE n_nationkey % 3 <> 0
)
"""


def _money(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def _whole(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def _share(top: str, bottom: str) -> str:
    return f"(CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0))"


def _rounded(expression: str) -> str:
    return f"round({expression}, 9)"


LEDGER_TEXT = "Entity AS CCGName, RawType AS ExpenseType, RawArea AS ExpenseArea, RawSupplier AS Supplier"

COLLATE = {
    "file_summary": f"""
SELECT File, min(Entity) AS CCG,
       count(DISTINCT RawSupplier) + max(CASE WHEN RawSupplier IS NULL THEN 1 ELSE 0 END) AS Suppliers,
       count(*) AS Invoices, {_money("sum(Amount)")} AS Amount,
       row_number() OVER (ORDER BY File) AS Count
FROM raw GROUP BY File""",
    "collate_ledgers": f"""
SELECT {LEDGER_TEXT}, {_money("Amount")} AS Amount FROM raw""",
    "collation_check": f"""
SELECT count(DISTINCT Entity) + max(CASE WHEN Entity IS NULL THEN 1 ELSE 0 END) AS Bodies,
       count(*) AS Records, {_money("sum(Amount)")} AS NetAmount FROM raw""",
    "attach_body_code": f"""
SELECT {LEDGER_TEXT}, RawCode AS CCGCode, {_money("Amount")} AS Amount FROM coded""",
    "sign_split": f"""
SELECT {LEDGER_TEXT}, {_money("Amount")} AS Amount,
       CASE WHEN Amount > 0 THEN 1 ELSE 0 END AS PositiveFlag,
       {_money("CASE WHEN Amount > 0 THEN 0 ELSE Amount END")} AS Income,
       {_money("CASE WHEN Amount > 0 THEN Amount ELSE 0 END")} AS Spending
FROM raw""",
    "threshold_flag": f"""
SELECT {LEDGER_TEXT}, {_money("Amount")} AS Amount,
       CASE WHEN Amount >= 25000 THEN 1 ELSE 0 END AS InvoiceOver25k
FROM raw""",
    "normalise_text": f"""
SELECT upper(Entity) AS CCGName, upper(RawType) AS ExpenseType, upper(RawArea) AS ExpenseArea,
       upper(RawSupplier) AS Supplier, upper(RawCode) AS CCGCode, {_money("Amount")} AS Amount
FROM coded""",
    "recode_suppliers": f"""
SELECT CCGName, CCGCode, ExpenseType, ExpenseArea, PositiveFlag, InvoiceOver25k,
       CASE WHEN CCGCode IN ('3', '5') AND Supplier = 'SUPPLIER#000000011'
              THEN 'SUPPLIER#000000011 (NORTH)'
            WHEN CCGCode = '4' AND Supplier IN ('SUPPLIER#000000011', 'SUPPLIER#000000012')
              THEN 'SUPPLIER#000000011 (SOUTH)'
            ELSE Supplier END AS Supplier,
       {_money("Amount")} AS Amount, {_money("Income")} AS Income,
       {_money("Spending")} AS Spending
FROM invoices""",
    "unique_suppliers": "SELECT DISTINCT Supplier FROM invoices",
}

_MONEY_COLUMNS = ", ".join(f"{_money(c)} AS {c}" for c in ("Amount", "Income", "Spending"))
ENRICH = {
    "enrich_ledger": f"""
SELECT * EXCLUDE (Amount, Income, Spending), {_MONEY_COLUMNS} FROM combined""",
    "valid_extract": f"""
SELECT * EXCLUDE (Amount, Income, Spending), {_MONEY_COLUMNS} FROM extract""",
    "extract_summary": f"""
SELECT (SELECT count(*) FROM (SELECT Supplier FROM extract GROUP BY Supplier)) AS NamedSuppliers,
       (SELECT count(*) FROM (SELECT SUPPLIER_STANDARD_NAME FROM extract GROUP BY ALL))
         AS StandardSuppliers,
       (SELECT count(*) FROM extract) AS Invoices,
       (SELECT {_money("sum(Spending)")} FROM extract) AS Spending""",
}


def _missing(column: str, count: str, share: str) -> str:
    return f"""
 (SELECT a.CCGName, a.TotalRecords, coalesce(m.{count}, 0) AS {count},
         {_share(f"coalesce(m.{count}, 0)", "a.TotalRecords")} AS {share}
  FROM (SELECT CCGName, count(*) AS TotalRecords FROM invoices GROUP BY CCGName) a
  LEFT JOIN (SELECT CCGName, count(*) AS {count} FROM invoices
             WHERE {column} IS NULL GROUP BY CCGName) m USING (CCGName))"""


_AREA = _missing("ExpenseArea", "MissingEA", "Percent_EA")
_TYPE = _missing("ExpenseType", "MissingET", "Percent_ET")
_INDICATOR = f"""
 (SELECT e.CCGName, e.TotalRecords, e.MissingEA, e.Percent_EA, t.MissingET, t.Percent_ET,
         e.Percent_EA + t.Percent_ET AS Indicator
  FROM {_AREA} e LEFT JOIN {_TYPE} t ON t.CCGName = e.CCGName)"""

_THRESHOLD = f"""
 (SELECT *, row_number() OVER (ORDER BY PercentUnder, CCGName) AS CCG
  FROM (SELECT *, {_share("s.Over", "Total")} AS PercentOver,
               1 - {_share("s.Over", "Total")} AS PercentUnder
        FROM (SELECT CCGName, min(CCGCode) AS CCGCode, {_whole("sum(InvoiceOver25k)")} AS Over,
                     count(*) AS Total
              FROM invoices WHERE PositiveFlag = 1 GROUP BY CCGName) s))"""
_THRESHOLD_COLUMNS = f"""CCGName, CCGCode, t.Over AS Over, Total,
       {_rounded("PercentOver")} AS PercentOver, {_rounded("PercentUnder")} AS PercentUnder, CCG"""


def _groups(column: str, where: str, table: str = "combined") -> str:
    return f"(SELECT count(*) FROM (SELECT {column} FROM {table} WHERE {where} GROUP BY {column}))"


def _nested(column: str) -> str:
    return f"""
SELECT {_groups(column, "true")} AS InLedger, {_groups(column, "PositiveFlag = 1")} AS Payments,
       {_groups(column, "InvoiceOver25k = 1")} AS OverThreshold,
       {_groups(column, "true", "extract")} AS InExtract"""


QUALITY = {
    "bodies_covered": f"""
SELECT {_groups("CCGCode", "true")} AS FullBodies,
       {_groups("CCGCode", "true", "extract")} AS ExtractBodies""",
    "bad_records": f"""
SELECT count(*) AS BadRecords,
       {_rounded(_share("count(*)", "(SELECT count(*) FROM combined)"))} AS ShareOfRecords
FROM combined WHERE Supplier IS NULL OR Redacted = 1 OR PHB_CHC = 1 OR Uninformative = 1""",
    "missing_expense_totals": f"""
SELECT a AS MissingEA, {_rounded(_share("a", "n"))} AS ShareEA,
       t AS MissingET, {_rounded(_share("t", "n"))} AS ShareET
FROM (SELECT (SELECT count(*) FROM invoices WHERE ExpenseArea IS NULL) AS a,
             (SELECT count(*) FROM invoices WHERE ExpenseType IS NULL) AS t,
             (SELECT count(*) FROM invoices) AS n)""",
    "missing_area_by_body": f"""
SELECT CCGName, TotalRecords, MissingEA, {_rounded("Percent_EA")} AS Percent_EA
FROM (SELECT * FROM {_AREA} ORDER BY Percent_EA DESC, CCGName LIMIT 20)""",
    "missing_type_by_body": f"""
SELECT CCGName, TotalRecords, MissingET, {_rounded("Percent_ET")} AS Percent_ET
FROM (SELECT * FROM {_TYPE} ORDER BY Percent_ET DESC, CCGName LIMIT 20)""",
    "missing_indicator": f"""
SELECT CCGName, TotalRecords, MissingEA, {_rounded("Percent_EA")} AS Percent_EA, MissingET,
       {_rounded("Percent_ET")} AS Percent_ET, {_rounded("Indicator")} AS Indicator
FROM (SELECT * FROM {_INDICATOR} ORDER BY Indicator DESC, Percent_EA DESC, CCGName LIMIT 25)""",
    "missing_concentration": f"""
SELECT {_rounded(_share("sum(MissingEA + MissingET) FILTER (place <= 14)",
                        "sum(MissingEA + MissingET)"))} AS ShareOfMissing
FROM (SELECT *, row_number() OVER (ORDER BY Indicator DESC, Percent_EA DESC, CCGName) AS place
      FROM {_INDICATOR})""",
    "ledger_totals": f"""
SELECT count(*) AS Records, {_whole("sum(PositiveFlag)")} AS Payments,
       {_money("sum(Spending)")} AS Spending,
       count(*) - {_whole("sum(PositiveFlag)")} AS IncomeRecords, {_money("sum(Income)")} AS Income
FROM invoices""",
    "threshold_totals": f"""
SELECT count(*) AS OverInvoices,
       {_rounded(_share("count(*)", "(SELECT sum(PositiveFlag) FROM invoices)"))} AS ShareOfPayments,
       {_money("coalesce(sum(Spending), 0)")} AS OverSpending,
       {_rounded(_share("coalesce(sum(Spending), 0)", "(SELECT sum(Spending) FROM invoices)"))} AS ShareOfSpending
FROM invoices WHERE InvoiceOver25k = 1""",
    "threshold_split": f"SELECT {_THRESHOLD_COLUMNS} FROM {_THRESHOLD} t",
    "threshold_split_ends": f"""
SELECT {_THRESHOLD_COLUMNS}, 'head' AS End FROM {_THRESHOLD} t WHERE CCG <= 22
UNION ALL
SELECT {_THRESHOLD_COLUMNS}, 'tail' AS End
FROM (SELECT * FROM {_THRESHOLD} ORDER BY CCG DESC LIMIT 4) t""",
    "named_supplier_counts": _nested("Supplier"),
    "standard_supplier_counts": _nested("SUPPLIER_STANDARD_NAME"),
    "extract_totals": f"""
SELECT count(*) AS Invoices, {_groups("CCGName", "true", "extract")} AS Bodies,
       {_groups("Supplier", "true", "extract")} AS NamedSuppliers,
       {_groups("SUPPLIER_STANDARD_NAME", "true", "extract")} AS StandardSuppliers,
       {_money("sum(Spending)")} AS Spending,
       {_rounded(_share("sum(Spending)", "(SELECT sum(Spending) FROM combined)"))} AS ShareOfSpending
FROM extract""",
}

SECTOR_NAMES = [
    "CareHome",
    "Executor",
    "GOV",
    "GPServices",
    "Hospice",
    "LA",
    "LMC_LPC",
    "NHS",
    "Other",
    "PharmOp",
    "PoliceFire",
    "School",
    "Solicitor",
    "University",
]
_SECTOR_SUMS = ", ".join(
    f"coalesce(sum(Spending) FILTER (SupplierSector = '{s}'), 0) AS {s}" for s in SECTOR_NAMES
)
_WIDE = f"""
 (SELECT *, {" + ".join(SECTOR_NAMES)} AS Total
  FROM (SELECT CCGName, {_SECTOR_SUMS} FROM extract GROUP BY CCGName))"""
_BODY_SPEND = """
 (SELECT SUPPLIER_STANDARD_NAME, count(*) AS Invoices, sum(Spending) AS Spending
  FROM extract WHERE CCGName = '{body}' GROUP BY ALL)"""
_GP = f"""
 (SELECT *, row_number() OVER (ORDER BY Percent_GPSpend NULLS LAST, CCGName) AS CCG
  FROM (SELECT t.CCGName, g.CCGCode, t.TotalSpend, g.GPSpend,
               {_share("g.GPSpend", "t.TotalSpend")} AS Percent_GPSpend
        FROM (SELECT CCGName, sum(Spending) AS TotalSpend FROM extract GROUP BY CCGName) t
        LEFT JOIN (SELECT CCGName, min(CCGCode) AS CCGCode, sum(Spending) AS GPSpend
                   FROM extract WHERE GPServices = 1 GROUP BY CCGName) g USING (CCGName)))"""


def _nth(body: str, ranks: str) -> str:
    source = _BODY_SPEND.format(body=body)
    places = len(ranks.split(","))
    picked = f"sum(Spending) FILTER (place IN ({ranks}))"
    return f"""
SELECT '{body}' AS CCGName,
       CASE WHEN count(*) FILTER (place IN ({ranks})) = {places}
            THEN {_rounded(_share(picked, "sum(Spending)"))} END AS Share
FROM (SELECT *, row_number() OVER (ORDER BY Spending DESC, SUPPLIER_STANDARD_NAME) AS place
      FROM {source})"""


def _flagged(flag: str) -> str:
    suppliers = _groups("SUPPLIER_STANDARD_NAME", f"{flag} = 1", "extract")
    everyone = _groups("SUPPLIER_STANDARD_NAME", "true", "extract")
    return f"""
SELECT {suppliers} AS Suppliers, {_rounded(_share(suppliers, everyone))} AS ShareOfSuppliers,
       count(*) AS Invoices,
       {_rounded(_share("count(*)", "(SELECT count(*) FROM extract)"))} AS ShareOfInvoices,
       {_money("coalesce(sum(Spending), 0)")} AS Spending,
       {_rounded(_share("coalesce(sum(Spending), 0)", "(SELECT sum(Spending) FROM extract)"))} AS ShareOfSpending
FROM extract WHERE {flag} = 1"""


_GP_BODIES = """
 (SELECT CCGName, SUPPLIER_STANDARD_NAME, sum(Spending) AS Spending FROM extract
  WHERE GPServices = 1
    AND CCGName IN ('NATION_3', 'NATION_4', 'NATION_5', 'NATION_6', 'NATION_7') GROUP BY ALL)"""

SECTORS = {
    "sector_split": f"""
SELECT SupplierSector, Invoices, {_money("Expenditure")} AS Expenditure,
       {_rounded(_share("Invoices", "(SELECT count(*) FROM extract)"))} AS PercentInvoices,
       {_rounded(_share("Expenditure", "(SELECT sum(Spending) FROM extract)"))} AS PercentExpenditure
FROM (SELECT SupplierSector, count(*) AS Invoices, sum(Spending) AS Expenditure
      FROM extract GROUP BY SupplierSector)""",
    "public_share": f"""
SELECT {_rounded(_share("count(*)", "(SELECT count(*) FROM extract)"))} AS PercentInvoices,
       {_rounded(_share("coalesce(sum(Spending), 0)", "(SELECT sum(Spending) FROM extract)"))} AS PercentExpenditure
FROM extract WHERE SupplierSector IN ('NHS', 'LA')""",
    "sector_pivot_by_body": f"""
SELECT CCGName, {", ".join(f"{_money(s)} AS {s}" for s in [*SECTOR_NAMES, "Total"])},
       {", ".join(f"{_rounded(_share(s, 'Total'))} AS PC_{s}" for s in SECTOR_NAMES)}
FROM {_WIDE}""",
    "public_share_by_body": f"""
SELECT CCGName, {_rounded("share")} AS PercentLA_NHS,
       row_number() OVER (ORDER BY share NULLS LAST, CCGName) AS CCG
FROM (SELECT CCGName, {_share("LA + NHS", "Total")} AS share FROM {_WIDE})""",
    "body_supplier_breakdown": f"""
SELECT SUPPLIER_STANDARD_NAME, Invoices, {_money("Spending")} AS Spending,
       {_rounded(_share("Spending", "(SELECT sum(Spending) FROM extract WHERE CCGName = 'NATION_3')"))}
         AS Percent
FROM {_BODY_SPEND.format(body="NATION_3")}""",
    "nth_supplier_share": _nth("NATION_3", "2, 3, 7") + "\nUNION ALL" + _nth("NATION_5", "1"),
    "gp_share_by_body": f"""
SELECT CCGName, CCGCode, {_money("TotalSpend")} AS TotalSpend, {_money("GPSpend")} AS GPSpend,
       {_rounded("Percent_GPSpend")} AS Percent_GPSpend
FROM {_GP}""",
    "gp_supplier_count": f"""
SELECT {_groups("SUPPLIER_STANDARD_NAME", "GPServices = 1", "extract")} AS GPSuppliers""",
    "gp_share_rank": f"""
SELECT CCGName, {_rounded("Percent_GPSpend")} AS Percent_GPSpend, CCG FROM {_GP}""",
    "gp_suppliers_for_body": f"""
SELECT CCGName, SUPPLIER_STANDARD_NAME, 0 AS IsTotal, {_money("Spending")} AS Spending
FROM {_GP_BODIES}
UNION ALL
SELECT CCGName, 'Total', 1, {_money("sum(Spending)")} FROM {_GP_BODIES} GROUP BY CCGName""",
    "flag_profile_nhs": _flagged("NHS"),
    "flag_profile_la": _flagged("LA"),
    "flag_profile_vcse": _flagged("VCSE_Status"),
}

STATUS_NAMES = {
    "CC&CH": "PC_CCandCH",
    "CCnotCH": "PC_CCnotCH",
    "CHnotCC": "PC_CHnotCC",
    "NotCCorCH": "PC_NotCCorCH",
}
_CATEGORY = """CASE SupplierSector WHEN 'CareHome' THEN 'Care Home' WHEN 'GPServices' THEN 'GP Services'
         WHEN 'Hospice' THEN 'Hospice' WHEN 'LA' THEN 'LA' WHEN 'NHS' THEN 'NHS'
         WHEN 'Other' THEN 'Other' ELSE 'Categorised Other' END"""
_CELLS = ", ".join(
    f"""coalesce(sum(x) FILTER (CCCH_Status = '{s}'), 0) AS "{s}" """ for s in STATUS_NAMES
)
_STATUS_SUM = " + ".join(f'"{s}"' for s in STATUS_NAMES)


def _cross(source: str) -> str:
    return f"""
 (SELECT *, {_STATUS_SUM} AS Total, {_CATEGORY} AS Category
  FROM (SELECT SupplierSector, {_CELLS} FROM {source} GROUP BY SupplierSector))"""


_COUNT_CROSS = _cross(
    """(SELECT SUPPLIER_STANDARD_NAME, arg_min(CCCH_Status, Supplier) AS CCCH_Status,
          arg_min(SupplierSector, Supplier) AS SupplierSector, 1 AS x
        FROM extract GROUP BY SUPPLIER_STANDARD_NAME)"""
)
_SPEND_CROSS = _cross("(SELECT CCCH_Status, SupplierSector, Spending AS x FROM extract)")
_ORDER_OF = """CAST(list_position(['NHS', 'LA', 'GP Services', 'Care Home', 'Hospice',
         'Categorised Other', 'Other', 'Total'], Category) AS BIGINT)"""


def _report(cross: str) -> str:
    sums = ", ".join(f'sum("{s}") AS "{s}"' for s in [*STATUS_NAMES, "Total"])
    return f"""
 (SELECT *, {_ORDER_OF} AS RowOrder
  FROM (SELECT Category, {sums} FROM {cross} GROUP BY Category
        UNION ALL SELECT 'Total', {sums} FROM {cross}))"""


def _crosstab(cross: str, convert) -> str:
    cells = ", ".join(f'{convert(chr(34) + s + chr(34))} AS "{s}"' for s in [*STATUS_NAMES, "Total"])
    quoted = {f'"{s}"': name for s, name in STATUS_NAMES.items()}
    shares = ", ".join(f"{_rounded(_share(s, 'Total'))} AS {n}" for s, n in quoted.items())
    return f"SELECT SupplierSector, {cells}, {shares}, Category FROM {cross}"


_REPORT_CELLS = [*STATUS_NAMES, "Total"]
_OUTSIDE = "CCCH_Status = 'NotCCorCH' AND SupplierSector NOT IN ('NHS', 'LA')"

SEGMENTS = {
    "CC_CH": "CCFound = 1 AND CHFound = 1",
    "CC_ONLY": "CCFound = 1 AND CHFound = 0",
    "CH_VCSE": "CCFound = 0 AND CHFound = 1 AND VCSE_Status = 1 AND NHS = 0 AND LA = 0 AND GOV = 0",
    "CH_NONVCSE": "CCFound = 0 AND CHFound = 1 AND VCSE_Status = 0 AND NHS = 0 AND LA = 0 AND GOV = 0",
    "PUBLIC": "NHS = 1 OR LA = 1 OR GOV = 1",
    "NONE_VCSE": "CCFound = 0 AND CHFound = 0 AND NHS = 0 AND LA = 0 AND GOV = 0 AND VCSE_Status = 1",
    "NONE_NONVCSE": "CCFound = 0 AND CHFound = 0 AND NHS = 0 AND LA = 0 AND GOV = 0 AND VCSE_Status = 0",
}


def _segment(name: str) -> str:
    form = "SupplierSector" if name == "PUBLIC" else "GivenCompanyCategory"
    return f"""
SELECT {form}, count(*) AS Suppliers, {_money("sum(Spending)")} AS Spending
FROM (SELECT {form}, SUPPLIER_STANDARD_NAME, sum(Spending) AS Spending
      FROM extract WHERE {SEGMENTS[name]} GROUP BY ALL)
GROUP BY {form}"""


_FORMS = "\n UNION ALL ".join(
    f"""
  SELECT '{name}' AS Segment, Form, count(*) AS Suppliers, sum(Spending) AS Spending
  FROM (SELECT {"SupplierSector" if name == "PUBLIC" else "GivenCompanyCategory"} AS Form,
               SUPPLIER_STANDARD_NAME, sum(Spending) AS Spending
        FROM extract WHERE {condition} GROUP BY ALL)
  GROUP BY Form"""
    for name, condition in SEGMENTS.items()
)
# Line of the report, label, places of the forms in their segment.
_FORM_LINES = [
    (0, "CC_CH", "Form", "place = 1"),
    (1, "CC_CH", "'Private Limited Companies by guarantee'", "place BETWEEN 3 AND 7"),
    (2, "CC_CH", "'Other Company Types'", "place IN (2, 8)"),
    (3, "CC_ONLY", "'Named charities'", "true"),
    (4, "CH_VCSE", "Form", "place IN (1, 2, 8, 9)"),
    (5, "CH_VCSE", "'Private Limited Companies by guarantee'", "place IN (3, 4, 5, 7)"),
    (6, "CH_VCSE", "Form", "place = 6"),
    (7, "CH_NONVCSE", "'Private Limited Companies by guarantee'", "place IN (7, 8, 9, 11)"),
    (8, "CH_NONVCSE", "'Other CH Company Types'", "place <= 6 OR place BETWEEN 12 AND 14"),
    (9, "CH_NONVCSE", "Form", "place = 10"),
    (10, "PUBLIC", "'Government Bodies'", "place = 1"),
    (11, "PUBLIC", "'Local Authorities'", "place = 2"),
    (12, "PUBLIC", "'NHS Organisations'", "place = 3"),
    (13, "NONE_VCSE", "'Other Suppliers (VCSE)'", "true"),
    (14, "NONE_NONVCSE", "'Other Suppliers (Non-VCSE)'", "true"),
]
_LINED = "\n UNION ALL ".join(
    f"""
  SELECT {line} AS line, {"place" if label == "Form" else 0} AS place, Segment,
         {label} AS LegalForm, Suppliers, Spending
  FROM placed WHERE Segment = '{segment}' AND ({places})"""
    for line, segment, label, places in _FORM_LINES
)
_FORM_REPORT = f"""
 (WITH forms AS ({_FORMS}),
  placed AS (SELECT *, row_number() OVER (PARTITION BY Segment ORDER BY Form NULLS LAST) AS place
             FROM forms)
  SELECT row_number() OVER (ORDER BY line, place) AS RowOrder, Segment, LegalForm,
         CASE WHEN Segment IN ('CC_CH', 'CC_ONLY', 'CH_VCSE', 'NONE_VCSE') THEN 'VCSE'
              ELSE 'Non-VCSE' END AS Side,
         {_whole("sum(Suppliers)")} AS Suppliers, sum(Spending) AS Spending
  FROM ({_LINED}) GROUP BY line, place, Segment, LegalForm)"""

REGISTERS = {
    "supplier_crosstab": _crosstab(_COUNT_CROSS, _whole),
    "supplier_crosstab_report": f"""
SELECT RowOrder, Category, {", ".join(f'{_whole(chr(34) + s + chr(34))} AS "{s}"' for s in _REPORT_CELLS)}
FROM {_report(_COUNT_CROSS)}""",
    "spending_crosstab": _crosstab(_SPEND_CROSS, _money),
    "spending_crosstab_report": f"""
SELECT RowOrder, Category,
       {", ".join(f'{_money(chr(34) + s + chr(34))} AS "{s}"' for s in _REPORT_CELLS)},
       {", ".join(f'round(CAST("{s}" AS DOUBLE) / 1000000, 9) AS "{s}_millions"' for s in _REPORT_CELLS)}
FROM {_report(_SPEND_CROSS)}""",
    "unregistered_share": f"""
SELECT n AS Suppliers, {_rounded(_share("n", "alln"))} AS ShareOfSuppliers,
       {_money("v")} AS Spending, {_rounded(_share("v", "allv"))} AS ShareOfSpending
FROM (SELECT
  (SELECT sum("NotCCorCH") FROM {_COUNT_CROSS} WHERE Category NOT IN ('NHS', 'LA'))::BIGINT AS n,
  (SELECT sum(Total) FROM {_COUNT_CROSS}) AS alln,
  (SELECT sum("NotCCorCH") FROM {_SPEND_CROSS} WHERE Category NOT IN ('NHS', 'LA')) AS v,
  (SELECT sum(Total) FROM {_SPEND_CROSS}) AS allv)""",
    "shared_subset": f"""
SELECT s.CCGName, e.* EXCLUDE (CCGName) REPLACE (CAST(Amount AS DOUBLE) AS Amount,
       CAST(Income AS DOUBLE) AS Income, CAST(Spending AS DOUBLE) AS Spending)
FROM shared s LEFT JOIN extract e ON e.CCGName = s.CCGName""",
    "register_counts_subset": """
SELECT (SELECT count(*) FROM (SELECT SUPPLIER_STANDARD_NAME FROM shared LEFT JOIN extract
          USING (CCGName) WHERE CCFound = 1 GROUP BY ALL)) AS Charities,
       (SELECT count(*) FROM (SELECT SUPPLIER_STANDARD_NAME FROM shared LEFT JOIN extract
          USING (CCGName) WHERE CHFound = 1 GROUP BY ALL)) AS Companies""",
    "register_flags_by_body": f"""
SELECT s.CCGName, {_whole("sum(e.CCFound)")} AS Charities, {_whole("sum(e.CHFound)")} AS Companies
FROM shared s LEFT JOIN extract e ON e.CCGName = s.CCGName GROUP BY s.CCGName""",
    "legal_form_cc_ch": _segment("CC_CH"),
    "legal_form_cc_only": _segment("CC_ONLY"),
    "legal_form_ch_vcse": _segment("CH_VCSE"),
    "legal_form_ch_nonvcse": _segment("CH_NONVCSE"),
    "legal_form_public": _segment("PUBLIC"),
    "legal_form_none_vcse": _segment("NONE_VCSE"),
    "legal_form_none_nonvcse": _segment("NONE_NONVCSE"),
    "legal_form_report": f"""
SELECT RowOrder, Segment, LegalForm, Side, Suppliers, {_money("Spending")} AS Spending
FROM {_FORM_REPORT}""",
    "legal_form_checksum": f"""
SELECT Side, {_whole("sum(Suppliers)")} AS Suppliers, {_money("sum(Spending)")} AS Spending
FROM {_FORM_REPORT} GROUP BY Side
UNION ALL
SELECT 'Total', {_whole("sum(Suppliers)")}, {_money("sum(Spending)")} FROM {_FORM_REPORT}""",
}

_VCSE = """
 (SELECT SUPPLIER_STANDARD_NAME, count(*) AS Invoices, sum(Spending) AS Spending
  FROM extract WHERE VCSE_Status = 1 GROUP BY SUPPLIER_STANDARD_NAME)"""
_VCSE_RANKED = f"""
 (SELECT *, row_number() OVER (ORDER BY Spending DESC, SUPPLIER_STANDARD_NAME) AS ID FROM {_VCSE})"""
_VCSE_BODIES = """
 (SELECT SUPPLIER_STANDARD_NAME, count(*) AS CCGCount, sum(Spending) AS Spending
  FROM (SELECT SUPPLIER_STANDARD_NAME, CCGName, sum(Spending) AS Spending
        FROM extract WHERE VCSE_Status = 1 GROUP BY ALL) GROUP BY SUPPLIER_STANDARD_NAME)"""
_BANDS = [40000000, 20000000, 10000000, 1000000]
_OUTLIERS = {
    "high spend": "Spending > 20e6 AND CCGCount < 40",
    "mid": "Spending > 9e6 AND Spending < 12e6 AND CCGCount > 10 AND CCGCount < 26",
    "few bodies": "Spending < 20e6 AND CCGCount > 5 AND CCGCount < 25",
    "most bodies": "CCGCount > 24",
    "many bodies": "Spending < 11e6 AND CCGCount > 17 AND CCGCount < 26",
    "one body": "Spending < 25e6 AND CCGCount < 2",
}

SUPPLIERS = {
    "vcse_suppliers": f"""
SELECT ID, SUPPLIER_STANDARD_NAME, Invoices, {_money("Spending")} AS Spending FROM {_VCSE_RANKED}""",
    "spend_bands": "\nUNION ALL".join(
        f"""
SELECT {_whole(str(cut))} AS Threshold, count(*) AS Suppliers,
       {_rounded(_share("count(*)", f"(SELECT count(*) FROM {_VCSE})"))} AS ShareOfSuppliers,
       {_rounded(_share("coalesce(sum(Spending), 0)", f"(SELECT sum(Spending) FROM {_VCSE})"))}
         AS ShareOfSpending
FROM {_VCSE} WHERE Spending > {cut}"""
        for cut in _BANDS
    ),
    "vcse_top_names": f"""
SELECT ID, SUPPLIER_STANDARD_NAME, {_money("Spending")} AS Spending
FROM {_VCSE_RANKED} WHERE Spending > 20000000""",
    "vcse_body_counts": f"""
SELECT SUPPLIER_STANDARD_NAME, CCGCount, {_money("Spending")} AS Spending FROM {_VCSE_BODIES}""",
    "vcse_outliers": "\nUNION ALL".join(
        f"""
SELECT '{label}' AS Outlier, SUPPLIER_STANDARD_NAME, CCGCount, {_money("Spending")} AS Spending
FROM {_VCSE_BODIES} WHERE {condition}"""
        for label, condition in _OUTLIERS.items()
    ),
    "supplier_by_body": f"""
SELECT SUPPLIER_STANDARD_NAME, CCGName, {_money("sum(Spending)")} AS Spend
FROM extract WHERE SUPPLIER_STANDARD_NAME IN ('STD#6', 'STD#12') GROUP BY ALL""",
}

_SPLIT = f"""
 (SELECT *, row_number() OVER (ORDER BY PC_NonNHSLASpend DESC NULLS LAST, CCGName) AS ID
  FROM (SELECT *, {_share("NHSLASpend", "TotalSpend")} AS PC_NHSLASpend,
          {_share("NonNHSLASpend", "TotalSpend")} AS PC_NonNHSLASpend,
          {_share("NonNHSLAVCSESpend", "TotalSpend")} AS PC_NonNHSLAVCSESpend,
          {_share("NonNHSLANonVCSESpend", "TotalSpend")} AS PC_NonNHSLAVCSENonSpend,
          {_share("NonNHSLAVCSESpend", "NonNHSLASpend")} AS VCSEofNonNHSLASpend,
          {_share("NonNHSLANonVCSESpend", "NonNHSLASpend")} AS NonVCSEofNonNHSLASpend
        FROM (SELECT CCGName, min(CCGCode) AS CCGCode, sum(Spending) AS TotalSpend,
                coalesce(sum(Spending) FILTER (NHS = 1 OR LA = 1), 0) AS NHSLASpend,
                coalesce(sum(Spending) FILTER (NHS = 0 AND LA = 0), 0) AS NonNHSLASpend,
                coalesce(sum(Spending) FILTER (NHS = 0 AND LA = 0 AND VCSE_Status = 1), 0)
                  AS NonNHSLAVCSESpend,
                coalesce(sum(Spending) FILTER (NHS = 0 AND LA = 0 AND VCSE_Status = 0), 0)
                  AS NonNHSLANonVCSESpend
              FROM extract GROUP BY CCGName)))"""
_SPLIT_MONEY = [
    "TotalSpend",
    "NHSLASpend",
    "NonNHSLASpend",
    "NonNHSLAVCSESpend",
    "NonNHSLANonVCSESpend",
]
_SPLIT_SHARES = [
    "PC_NHSLASpend",
    "PC_NonNHSLASpend",
    "PC_NonNHSLAVCSESpend",
    "PC_NonNHSLAVCSENonSpend",
    "VCSEofNonNHSLASpend",
    "NonVCSEofNonNHSLASpend",
]
_PER_CAPITA = f"""
 (SELECT * EXCLUDE (before),
         row_number() OVER (ORDER BY PerCapitaVCSESpend DESC NULLS LAST, before) AS ID
  FROM (SELECT s.ID AS before, s.CCGCode, s.CCGName, s.NonNHSLAVCSESpend, p.Mid2018Pop,
               {_share("s.NonNHSLAVCSESpend", "p.Mid2018Pop")} AS PerCapitaVCSESpend
        FROM {_SPLIT} s LEFT JOIN population p ON p.CCGCode = s.CCGCode))"""
_PER_CAPITA_COLUMNS = f"""CCGCode, CCGName, {_money("NonNHSLAVCSESpend")} AS NonNHSLAVCSESpend,
       Mid2018Pop, {_rounded("PerCapitaVCSESpend")} AS PerCapitaVCSESpend, ID"""
_UNITS = f"""
 (SELECT *, {_share("VCSESpend", "Population")} AS PercapitaSpend
  FROM (SELECT CCGCode2020, min(CCGName2020) AS CCGName2020, sum(NonNHSLAVCSESpend) AS VCSESpend,
               {_whole("sum(Mid2018Pop)")} AS Population
        FROM {_PER_CAPITA} c LEFT JOIN geography g ON g.CCGCode = c.CCGCode GROUP BY CCGCode2020))"""
_UNIT_COLUMNS = f"""CCGCode2020, CCGName2020, {_money("VCSESpend")} AS VCSESpend, Population,
       {_rounded("PercapitaSpend")} AS PercapitaSpend"""
_UNIT_RANK = f"""
 (SELECT *, row_number() OVER (ORDER BY PercapitaSpend DESC NULLS LAST, CCGCode2020) AS ID
  FROM {_UNITS} WHERE CCGName2020 <> 'ASIA')"""

BODIES = {
    "spend_split_by_body": f"""
SELECT CCGName, CCGCode, {", ".join(f"{_money(c)} AS {c}" for c in _SPLIT_MONEY)},
       {", ".join(f"{_rounded(c)} AS {c}" for c in _SPLIT_SHARES)}, ID
FROM {_SPLIT}""",
    "stacked_shares": f"""
SELECT ID, CCGName, {_rounded("PC_NHSLASpend")} AS PC_NHSLASpend,
       {_rounded("PC_NonNHSLAVCSESpend")} AS PC_NonNHSLAVCSESpend,
       {_rounded("PC_NonNHSLAVCSENonSpend")} AS PC_NonNHSLAVCSENonSpend,
       {_rounded("PC_NHSLASpend + PC_NonNHSLAVCSESpend")} AS Line2
FROM {_SPLIT}""",
    "vcse_share_of_nonpublic": f"""
SELECT CCGName, {_rounded("VCSEofNonNHSLASpend")} AS VCSEofNonNHSLASpend,
       row_number() OVER (ORDER BY VCSEofNonNHSLASpend DESC NULLS LAST, before) AS ID
FROM (SELECT * EXCLUDE (ID), ID AS before FROM {_SPLIT})""",
    "vcse_share_of_total": f"""
SELECT CCGName, {_money("TotalSpend")} AS TotalSpend,
       {_money("NonNHSLAVCSESpend")} AS NonNHSLAVCSESpend,
       {_rounded("PC_NonNHSLAVCSESpend")} AS PC_VCSESpend,
       row_number() OVER (ORDER BY PC_NonNHSLAVCSESpend DESC NULLS LAST, before) AS ID
FROM (SELECT * EXCLUDE (ID), ID AS before FROM {_SPLIT})""",
    "per_capita_spend": f"SELECT {_PER_CAPITA_COLUMNS} FROM {_PER_CAPITA}",
    "case_study_flag": f"""
SELECT {_PER_CAPITA_COLUMNS},
       CASE WHEN ID IN (3, 8, 15, 21) THEN 'CaseStudy' ELSE 'Other' END AS CaseStudyShortList
FROM {_PER_CAPITA}""",
    "rank_quartile": f"""
SELECT {_PER_CAPITA_COLUMNS},
       {_whole("ceil(ID * 4.0 / (SELECT count(DISTINCT CCGName) FROM extract))")} AS Quartile
FROM {_PER_CAPITA}""",
    "successor_rollup": f"SELECT {_UNIT_COLUMNS} FROM {_UNITS}",
    "successor_rank": f"SELECT {_UNIT_COLUMNS}, ID FROM {_UNIT_RANK}",
    "complete_successor_rank": f"""
SELECT {_UNIT_COLUMNS},
       row_number() OVER (ORDER BY PercapitaSpend DESC NULLS LAST, CCGCode2020) AS ID
FROM {_UNITS}
WHERE CCGCode2020 IS NOT NULL AND CCGCode2020 NOT IN
  (SELECT CCGCode2020 FROM geography WHERE CCGCode2020 IS NOT NULL
     AND CCGCode NOT IN (SELECT CCGCode FROM extract WHERE CCGCode IS NOT NULL))""",
    "successor_case_study": f"""
SELECT {_UNIT_COLUMNS}, ID,
       {_whole("CASE WHEN ID <= 1 THEN 1 WHEN ID <= 2 THEN 2 WHEN ID <= 3 THEN 3 ELSE 4 END")}
         AS Quartile,
       CASE WHEN ID IN (2, 4) THEN 'CaseStudy' ELSE 'Other' END AS CaseStudy
FROM {_UNIT_RANK}""",
}

_WANTED = "CCGName IN ('NATION_3', 'NATION_4', 'NATION_5', 'NATION_6')"
_WANTED_UNITS = "CCGName2020 IN ('AMERICA', 'EUROPE')"


def _suppliers_of(keys: str) -> str:
    return f"""
 (SELECT a.*, v.CountVCSESuppliers, v.ValueVCSESuppliers
  FROM (SELECT {keys}, count(*) AS CountSuppliers, sum(Spending) AS ValueSuppliers
        FROM (SELECT {keys}, SUPPLIER_STANDARD_NAME, sum(Spending) AS Spending FROM combined
              WHERE PositiveFlag = 1 GROUP BY ALL) GROUP BY ALL) a
  LEFT JOIN (SELECT {keys}, count(*) AS CountVCSESuppliers, sum(Spending) AS ValueVCSESuppliers
        FROM (SELECT {keys}, SUPPLIER_STANDARD_NAME, sum(Spending) AS Spending FROM combined
              WHERE VCSE_Status = 1 AND PositiveFlag = 1 GROUP BY ALL) GROUP BY ALL) v
  USING ({keys}))"""


_SUPPLIER_COLUMNS = f"""CountSuppliers, {_money("ValueSuppliers")} AS ValueSuppliers,
       CountVCSESuppliers, {_money("ValueVCSESuppliers")} AS ValueVCSESuppliers"""


def _value(table: str) -> str:
    return f"""
SELECT CCGName, {_money("TotValue")} AS TotValue, {_money("VCSESpend")} AS VCSESpend,
       {_rounded("share")} AS PercentVCSESpend, Rank
FROM (SELECT *, row_number() OVER (ORDER BY share DESC NULLS LAST, CCGName) AS Rank
      FROM (SELECT *, {_share("VCSESpend", "TotValue")} AS share
            FROM (SELECT CCGName, sum(Spending) AS TotValue,
                         sum(VCSE_Status * Spending) AS VCSESpend
                  FROM {table} WHERE PositiveFlag = 1 GROUP BY CCGName)))
WHERE {_WANTED}"""


def _unit_value(table: str, rank: str) -> str:
    return f"""
SELECT CCGName2020, {_money("TotValue")} AS TotValue, {_money("VCSESpend")} AS VCSESpend,
       {_rounded("share")} AS PercentVCSESpend, place AS {rank}
FROM (SELECT *, row_number() OVER (ORDER BY share DESC NULLS LAST, CCGName2020) AS place
      FROM (SELECT *, {_share("VCSESpend", "TotValue")} AS share
            FROM (SELECT CCGName2020, sum(TotValue) AS TotValue, sum(VCSESpend) AS VCSESpend
                  FROM (SELECT CCGCode, sum(Spending) AS TotValue,
                               sum(VCSE_Status * Spending) AS VCSESpend
                        FROM {table} WHERE PositiveFlag = 1 GROUP BY CCGCode) c
                  LEFT JOIN geography g USING (CCGCode) GROUP BY CCGName2020)
            WHERE CCGName2020 <> 'ASIA'))
WHERE {_WANTED_UNITS}"""


PROFILE = {
    "profile_vcse_spend": f"""
SELECT CCGName, {_money("TotVCSESpend")} AS TotVCSESpend, Invoices, VCSESpendRank,
       {_rounded("per")} AS PerTransaction, VCSEPerTransactionRank
FROM (SELECT *, row_number() OVER (ORDER BY per DESC NULLS LAST, VCSESpendRank)
               AS VCSEPerTransactionRank
      FROM (SELECT *, {_share("TotVCSESpend", "Invoices")} AS per,
                   row_number() OVER (ORDER BY TotVCSESpend DESC, CCGName) AS VCSESpendRank
            FROM (SELECT CCGName, sum(Spending) AS TotVCSESpend, count(*) AS Invoices
                  FROM combined WHERE VCSE_Status = 1 AND PositiveFlag = 1 GROUP BY CCGName)))
WHERE {_WANTED}""",
    "profile_vcse_invoice_share": f"""
SELECT CCGName, TotInvoices, VCSEInvoices, {_rounded("share")} AS PercentInvoicesVCSE, Rank
FROM (SELECT *, row_number() OVER (ORDER BY share DESC NULLS LAST, CCGName) AS Rank
      FROM (SELECT *, {_share("VCSEInvoices", "TotInvoices")} AS share
            FROM (SELECT CCGName, count(*) AS TotInvoices,
                         {_whole("sum(VCSE_Status)")} AS VCSEInvoices
                  FROM combined WHERE PositiveFlag = 1 GROUP BY CCGName)))
WHERE {_WANTED}""",
    "profile_vcse_value_share": _value("combined"),
    "profile_supplier_counts": f"""
SELECT CCGName, {_SUPPLIER_COLUMNS} FROM {_suppliers_of("CCGName")} WHERE {_WANTED}""",
    "profile_supplier_share_rank": f"""
SELECT CCGName, {_SUPPLIER_COLUMNS}, {_rounded("share")} AS PercentCountVCSE, CountRank,
       {_rounded(_share("ValueVCSESuppliers", "ValueSuppliers"))} AS PercentSpendVCSE, ValueRank
FROM (SELECT *, row_number() OVER (ORDER BY share DESC NULLS LAST, CountRank) AS ValueRank
      FROM (SELECT *, row_number() OVER (ORDER BY share DESC NULLS LAST, CCGName) AS CountRank
            FROM (SELECT *, {_share("CountVCSESuppliers", "CountSuppliers")} AS share
                  FROM {_suppliers_of("CCGName")})))
WHERE {_WANTED}""",
    "profile_supplier_count_rank": f"""
SELECT CCGName, {_SUPPLIER_COLUMNS}, {_rounded("share")} AS PercentCountVCSE, CountRank, PercentRank
FROM (SELECT *, row_number() OVER (ORDER BY share DESC NULLS LAST, CountRank) AS PercentRank
      FROM (SELECT *, row_number() OVER (ORDER BY CountVCSESuppliers DESC NULLS LAST, CCGName)
                     AS CountRank
            FROM (SELECT *, {_share("CountVCSESuppliers", "CountSuppliers")} AS share
                  FROM {_suppliers_of("CCGName")})))
WHERE {_WANTED}""",
    "profile_extract_value_share": _value("extract"),
    "successor_vcse_spend": f"""
SELECT CCGName2020, {_money("VCSESpend")} AS VCSESpend, {_whole("TotInvoices")} AS TotInvoices,
       {_rounded("per")} AS PertransactionSpend, VCSESpendRank, PertransactionSpendRank
FROM (SELECT *, row_number() OVER (ORDER BY per DESC NULLS LAST, VCSESpendRank)
               AS PertransactionSpendRank
      FROM (SELECT *, {_share("VCSESpend", "TotInvoices")} AS per,
                   row_number() OVER (ORDER BY VCSESpend DESC, CCGName2020) AS VCSESpendRank
            FROM (SELECT CCGName2020, sum(Spend) AS VCSESpend, sum(Invoices) AS TotInvoices
                  FROM (SELECT CCGCode, sum(Spending) AS Spend, count(*) AS Invoices FROM combined
                        WHERE VCSE_Status = 1 AND PositiveFlag = 1 GROUP BY CCGCode) c
                  LEFT JOIN geography g USING (CCGCode) GROUP BY CCGName2020)
            WHERE CCGName2020 <> 'ASIA'))
WHERE {_WANTED_UNITS}""",
    "successor_invoice_share": f"""
SELECT CCGName2020, {_whole("VCSEInvoices")} AS VCSEInvoices, {_whole("TotInvoices")} AS TotInvoices,
       {_rounded("share")} AS PertransactionSpend, Rank
FROM (SELECT *, row_number() OVER (ORDER BY share DESC NULLS LAST, CCGName2020) AS Rank
      FROM (SELECT *, {_share("VCSEInvoices", "TotInvoices")} AS share
            FROM (SELECT CCGName2020, sum(v) AS VCSEInvoices, sum(n) AS TotInvoices
                  FROM (SELECT CCGCode, count(*) AS n, sum(VCSE_Status) AS v FROM combined
                        WHERE PositiveFlag = 1 GROUP BY CCGCode) c
                  LEFT JOIN geography g USING (CCGCode) GROUP BY CCGName2020)
            WHERE CCGName2020 <> 'ASIA'))
WHERE {_WANTED_UNITS}""",
    "successor_value_share": _unit_value("combined", "Rank"),
    "successor_supplier_counts": f"""
SELECT CCGName2020, {_SUPPLIER_COLUMNS}, {_rounded("share")} AS PercentVCSESuppliers, CountRank,
       PercentRank
FROM (SELECT *, row_number() OVER (ORDER BY share DESC NULLS LAST, CountRank) AS PercentRank
      FROM (SELECT *, {_share("CountVCSESuppliers", "CountSuppliers")} AS share,
                   row_number() OVER (ORDER BY CountVCSESuppliers DESC NULLS LAST, CCGName2020)
                     AS CountRank
            FROM (SELECT CCGName2020, {_whole("sum(CountSuppliers)")} AS CountSuppliers,
                         sum(ValueSuppliers) AS ValueSuppliers,
                         CASE WHEN count(CountVCSESuppliers) = count(*)
                              THEN {_whole("sum(CountVCSESuppliers)")} END AS CountVCSESuppliers,
                         CASE WHEN count(ValueVCSESuppliers) = count(*)
                              THEN sum(ValueVCSESuppliers) END AS ValueVCSESuppliers
                  FROM {_suppliers_of("CCGCode")} c
                  LEFT JOIN geography g USING (CCGCode) GROUP BY CCGName2020)
            WHERE CCGName2020 <> 'ASIA'))
WHERE {_WANTED_UNITS}""",
    "successor_extract_value_share": _unit_value("extract", "PercentRank"),
    "body_names": "SELECT DISTINCT CCGName FROM invoices",
}


def statements() -> dict[str, str]:
    groups = [COLLATE, ENRICH, QUALITY, SECTORS, REGISTERS, SUPPLIERS, BODIES, PROFILE]
    return {name: BASE + body for group in groups for name, body in group.items()}
