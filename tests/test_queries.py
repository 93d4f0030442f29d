"""Every registered query against its SQL counterpart on the test tables."""

from __future__ import annotations

import importlib

import pytest
from compare import connect, difference

entry = importlib.import_module("__spark_entry__")
catalog = importlib.import_module("tallybook.catalog")
oracle = importlib.import_module("tallybook.oracle")
QUERIES = catalog.queries()
SQL = oracle.statements()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    mine = QUERIES[name](spark, sf_dir)
    theirs = duck.sql(SQL[name])
    assert difference(mine.toPandas(), theirs.df()) is None
    kinds = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE"}
    types = dict(zip(theirs.columns, [str(t) for t in theirs.types]))
    assert {c: kinds[t] for c, t in mine.dtypes} == types


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(
    "name",
    [
        "extract_totals",
        "standard_supplier_counts",
        "sector_pivot_by_body",
        "supplier_crosstab",
        "unregistered_share",
        "legal_form_report",
        "register_flags_by_body",
        "vcse_suppliers",
        "spend_split_by_body",
        "profile_vcse_value_share",
        "successor_supplier_counts",
        "valid_extract",
    ],
)
def test_query_without_broadcast(spark, sf_dir, duck, name):
    """The same results when no side may be broadcast and tallies are pre-aggregated."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for key in keys:
        spark.conf.set(key, "-1")
    try:
        mine = QUERIES[name](spark, sf_dir).toPandas()
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert difference(mine, duck.sql(SQL[name]).df()) is None
