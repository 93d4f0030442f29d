"""The ledger model laid over the generic test tables.

One line item is one ledger row. The paying body is the customer's nation, the
expense columns come from the part, the supplier name from the supplier. Every
lookup is by primary key and keeps all line items, so a lookup whose columns a
query does not read can be left out without changing a row.

A few names and codes are blanked out, and supplier attributes are derived from
the supplier key, two raw names sharing one standard name.
"""

from __future__ import annotations

from functools import cache, cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.plans import collate, enrich
from tallybook.schemas import SECTORS

AMOUNT = (
    "CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END"
    " AS DECIMAL(18,2))"
)


# The columns in use, with the types of the files.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_nationkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING",
    "part": "p_partkey BIGINT, p_brand STRING, p_type STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT,"
    " l_extendedprice DOUBLE, l_returnflag STRING",
}


class Testbed:
    """Ledger frames over one folder of tables.

    Frames are kept as unexecuted plans; no data is held.
    """

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    @cache
    def table(self, name: str) -> DataFrame:
        """A test table; the schema is given, so no file is opened to infer it."""
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cache
    def raw_ledger(self, *parts: str) -> DataFrame:
        """Raw ledger rows with the asked-for parts: body, expense, supplier, file."""
        rows = self.table("lineitem")
        columns = []
        if "body" in parts or "file" in parts:
            orders = self.table("orders").withColumnRenamed("o_orderkey", "l_orderkey")
            rows = rows.join(orders, "l_orderkey", "left")
        if "body" in parts:
            customers = self.table("customer").withColumnRenamed("c_custkey", "o_custkey")
            nations = self.table("nation").withColumnRenamed("n_nationkey", "c_nationkey")
            rows = rows.join(customers, "o_custkey", "left").join(nations, "c_nationkey", "left")
            columns.append("lower(n_name) AS Entity")
        if "expense" in parts:
            goods = self.table("part").withColumnRenamed("p_partkey", "l_partkey")
            rows = rows.join(goods, "l_partkey", "left")
            columns.append("lower(nullif(p_type, 'PROMO')) AS `Expense Type`")
            columns.append("lower(nullif(p_brand, 'Brand#7')) AS `Expense area`")
        if "supplier" in parts:
            names = self.table("supplier").withColumnRenamed("s_suppkey", "l_suppkey")
            rows = rows.join(names, "l_suppkey", "left")
            columns.append("CASE WHEN l_suppkey % 50 = 7 THEN NULL ELSE s_name END AS Supplier")
        columns.append(f"{AMOUNT} AS `AP Amount (£)`")
        if "file" in parts:
            columns.append("o_orderpriority AS File")
        return rows.selectExpr(*columns)

    @cached_property
    def body_codes(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "n_nationkey AS FID",
            "CAST(n_nationkey AS STRING) AS CCG18CD",
            "CAST(n_nationkey AS STRING) AS CCG18CDH",
            "n_name AS CCG18NM",
            "lower(n_name) AS OurNames",
        )

    @cache
    def invoices(self, *parts: str) -> DataFrame:
        """Clean invoices; without the body part there is no body to look up."""
        raw = self.raw_ledger(*parts)
        if "body" in parts:
            return collate.clean_ledger(raw, self.body_codes, rules=[])
        named = collate.friendly_names(raw)
        return collate.normalise_text(collate.threshold_flag(collate.sign_split(named)))

    @cache
    def measured(self, *parts: str) -> DataFrame:
        return enrich.measured(self.invoices(*parts))

    @cached_property
    def suppliers(self) -> DataFrame:
        """Supplier master, with one row for payments that name nobody."""
        sectors = ",".join(SECTORS)
        keyed = self.table("supplier").selectExpr(
            "s_suppkey AS k",
            "upper(s_name) AS Supplier",
            "s_suppkey div 2 AS j",
            f"split_part('{sectors}', ',', CAST((s_suppkey div 2) % 14 + 1 AS INT)) AS sector",
        )
        private = "sector NOT IN ('NHS', 'LA', 'GOV')"
        master = keyed.filter("k % 50 <> 7").selectExpr(
            "Supplier",
            "concat('STD#', j) AS SUPPLIER_STANDARD_NAME",
            "CAST(k % 23 = 5 AS INT) AS Redacted",
            "CAST(k % 29 = 6 AS INT) AS PHB_CHC",
            "CAST(k % 31 = 8 AS INT) AS Uninformative",
            "sector AS SupplierSector",
            f"CASE WHEN j % 3 = 0 AND {private} THEN if(j % 2 = 0, 'CC&CH', 'CCnotCH')"
            " ELSE if(j % 2 = 0, 'CHnotCC', 'NotCCorCH') END AS CCCH_Status",
            "concat('FORM_', j % 4) AS GivenCompanyCategory",
            f"CAST(j % 3 = 0 AND {private} AS INT) AS CCFound",
            "CAST(j % 2 = 0 AS INT) AS CHFound",
            "CAST(sector = 'NHS' AS INT) AS NHS",
            "CAST(sector = 'LA' AS INT) AS LA",
            "CAST(sector = 'GOV' AS INT) AS GOV",
            "CAST(sector = 'GPServices' AS INT) AS GPServices",
            f"CAST((j % 3 = 0 OR j % 5 = 1) AND {private} AS INT) AS VCSE_Status",
        )
        nobody = self.spark.range(1).selectExpr(
            *[
                f"CAST(NULL AS STRING) AS {f.name}"
                if f.dataType.simpleString() == "string"
                else f"{int(f.name == 'Redacted')} AS {f.name}"
                for f in master.schema.fields
            ]
        )
        return master.unionByName(nobody)

    @cached_property
    def population(self) -> DataFrame:
        return (
            self.table("customer")
            .groupBy("c_nationkey")
            .agg((F.count(F.lit(1)) * 1000).alias("Mid2018Pop"))
            .selectExpr("CAST(c_nationkey AS STRING) AS CCGCode", "Mid2018Pop")
        )

    @cached_property
    def geography(self) -> DataFrame:
        regions = self.table("region").withColumnRenamed("r_regionkey", "n_regionkey")
        placed = self.table("nation").join(regions, "n_regionkey", "left")
        columns = []
        for year in (2018, 2019):
            columns.append(f"CAST(n_nationkey AS STRING) AS CCGCode{year}")
            columns.append(f"n_name AS CCGName{year}")
            columns.append(f"n_name AS CCGLabel{year}")
        columns.append("CAST(n_regionkey AS STRING) AS CCGCode2020")
        columns.append("r_name AS CCGName2020")
        columns.append("r_name AS CCGLabel2020")
        return placed.selectExpr(*columns)

    @cached_property
    def shared_list(self) -> DataFrame:
        return self.table("nation").filter("n_nationkey % 3 <> 0").selectExpr("n_name AS CCGName")

    @cached_property
    def ledger(self) -> DataFrame:
        return enrich.ledger_tally(self.invoices("body", "supplier"), self.suppliers)

    @cached_property
    def payments(self) -> DataFrame:
        return enrich.payments_tally(self.invoices("body", "supplier"), self.suppliers)

    @cached_property
    def extract(self) -> DataFrame:
        return enrich.extract_tally(self.invoices("body", "supplier"), self.suppliers)

    @cached_property
    def extract_without_bodies(self) -> DataFrame:
        return enrich.extract_tally(self.invoices("supplier"), self.suppliers)

    @cached_property
    def ledger_without_bodies(self) -> DataFrame:
        return enrich.ledger_tally(self.invoices("supplier"), self.suppliers)


@lru_cache(maxsize=4)
def testbed(spark: SparkSession, sf_dir: str) -> Testbed:
    """The frames of a folder; queries in one session share the plans."""
    return Testbed(spark, sf_dir)
