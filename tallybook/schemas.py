"""Column lists, schemas and fixed domains of the ledger model."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# Raw headers of a body's ledger file, in file order.
RAW_LEDGER = T.StructType(
    [
        T.StructField("Entity", T.StringType()),
        T.StructField("Expense Type", T.StringType()),
        T.StructField("Expense area", T.StringType()),
        T.StructField("Supplier", T.StringType()),
        T.StructField("AP Amount (£)", MONEY),
    ]
)
LEDGER_COLUMNS = ["CCGName", "ExpenseType", "ExpenseArea", "Supplier", "Amount"]

INVOICES = T.StructType(
    [
        T.StructField("CCGName", T.StringType()),
        T.StructField("CCGCode", T.StringType()),
        T.StructField("ExpenseType", T.StringType()),
        T.StructField("ExpenseArea", T.StringType()),
        T.StructField("Supplier", T.StringType()),
        T.StructField("Amount", MONEY),
        T.StructField("PositiveFlag", T.IntegerType()),
        T.StructField("Income", MONEY),
        T.StructField("Spending", MONEY),
        T.StructField("InvoiceOver25k", T.IntegerType()),
    ]
)

SUPPLIERS = T.StructType(
    [
        T.StructField("Supplier", T.StringType()),
        T.StructField("SUPPLIER_STANDARD_NAME", T.StringType()),
        T.StructField("Redacted", T.IntegerType()),
        T.StructField("PHB_CHC", T.IntegerType()),
        T.StructField("Uninformative", T.IntegerType()),
        T.StructField("SupplierSector", T.StringType()),
        T.StructField("CCCH_Status", T.StringType()),
        T.StructField("GivenCompanyCategory", T.StringType()),
        T.StructField("CCFound", T.IntegerType()),
        T.StructField("CHFound", T.IntegerType()),
        T.StructField("NHS", T.IntegerType()),
        T.StructField("LA", T.IntegerType()),
        T.StructField("GOV", T.IntegerType()),
        T.StructField("GPServices", T.IntegerType()),
        T.StructField("VCSE_Status", T.IntegerType()),
    ]
)
VALIDITY_FLAGS = ["Redacted", "PHB_CHC", "Uninformative"]
# The extract keeps everything but the flags that are constant in it.
EXTRACT_COLUMNS = INVOICES.names + [c for c in SUPPLIERS.names[1:] if c not in VALIDITY_FLAGS]

MANIFEST = T.StructType([T.StructField("FileName", T.StringType())])
BODY_CODES = T.StructType(
    [
        T.StructField("FID", T.IntegerType()),
        T.StructField("CCG18CD", T.StringType()),
        T.StructField("CCG18CDH", T.StringType()),
        T.StructField("CCG18NM", T.StringType()),
        T.StructField("OurNames", T.StringType()),
    ]
)
POPULATION = T.StructType(
    [T.StructField("CCGCode", T.StringType()), T.StructField("Mid2018Pop", T.LongType())]
)
GEOGRAPHY = T.StructType(
    [
        T.StructField(f"CCG{kind}{year}", T.StringType())
        for year in (2018, 2019, 2020)
        for kind in ("Code", "Name", "Label")
    ]
)
SHARED_LIST = T.StructType([T.StructField("CCGName", T.StringType())])
THRESHOLD_SPLIT = T.StructType(
    [
        T.StructField("CCGName", T.StringType()),
        T.StructField("CCGCode", T.StringType()),
        T.StructField("Over", T.LongType()),
        T.StructField("Total", T.LongType()),
        T.StructField("PercentOver", T.DoubleType()),
        T.StructField("PercentUnder", T.DoubleType()),
        T.StructField("CCG", T.LongType()),
    ]
)

# The closed domains of the supplier master.
SECTORS = [
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
STATUSES = ["CC&CH", "CCnotCH", "CHnotCC", "NotCCorCH"]
STATUS_SHARE_NAMES = {
    "CC&CH": "PC_CCandCH",
    "CCnotCH": "PC_CCnotCH",
    "CHnotCC": "PC_CHnotCC",
    "NotCCorCH": "PC_NotCCorCH",
}
# Sector to report category; every other sector is OTHER_CATEGORY.
SECTOR_CATEGORIES = {
    "CareHome": "Care Home",
    "GPServices": "GP Services",
    "Hospice": "Hospice",
    "LA": "LA",
    "NHS": "NHS",
    "Other": "Other",
}
OTHER_CATEGORY = "Categorised Other"
# Display order of the report categories.
CATEGORY_ORDER = [
    "NHS",
    "LA",
    "GP Services",
    "Care Home",
    "Hospice",
    "Categorised Other",
    "Other",
    "Total",
]
