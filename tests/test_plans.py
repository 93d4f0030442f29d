"""Shape of the physical plans: no cross joins, no Python, no row sorts."""

from __future__ import annotations

import importlib
import re

import pytest

QUERIES = importlib.import_module("tallybook.catalog").queries()
BANNED = ["NestedLoopJoin", "CartesianProduct", "PythonUDF", "ArrowEvalPython", "MapInPandas"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_plan_shape(spark, sf_dir, name):
    plan = _plan(QUERIES[name](spark, sf_dir))
    assert not [word for word in BANNED if word in plan]
    for line, below in _sort_aggregates(plan):
        assert "HashAggregate" in below, f"rows are sorted to be aggregated: {line}"


def _sort_aggregates(plan: str):
    """Every partial sort aggregate with the operators under it, up to a join or scan."""
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "SortAggregate" in line and "partial_" in line:
            depth = len(re.match(r"[\s:+\-|*()\d]*", line).group())
            below = []
            for other in lines[i + 1 :]:
                if len(re.match(r"[\s:+\-|*()\d]*", other).group()) <= depth:
                    break
                if "Join" in other or "Scan" in other:
                    break
                below.append(other)
            yield line, "\n".join(below)


@pytest.mark.parametrize(
    "name, columns",
    [
        ("ledger_totals", {"l_extendedprice", "l_returnflag"}),
        ("threshold_split", {"l_orderkey", "l_suppkey", "l_extendedprice", "l_returnflag"}),
        ("missing_expense_totals", {"l_orderkey", "l_suppkey", "l_partkey"}),
    ],
)
def test_scan_reads_only_needed_columns(spark, sf_dir, name, columns):
    plan = _plan(QUERIES[name](spark, sf_dir))
    scans = [line for line in plan.splitlines() if "lineitem.parquet" in line]
    assert scans
    for line in scans:
        read = set(re.findall(r"(\w+):\w+", line.split("ReadSchema: struct<")[1]))
        assert read <= columns


def test_totals_reuse_the_shuffle_of_their_groups(spark, sf_dir):
    df = QUERIES["sector_split"](spark, sf_dir)
    df.collect()
    assert "ReusedExchange" in _plan(df)


def _scans(plan: str, table: str) -> int:
    """Scans of a table in the final plan; what is reused is printed as such, not as a scan again."""
    return sum(f"{table}.parquet" in line and "Scan parquet" in line for line in plan.splitlines())


def _ran(df) -> str:
    """The plan that ran: the final one, without the plan it started from."""
    df.collect()
    return re.split(r"\+- == Initial Plan ==", _plan(df))[0]


@pytest.mark.parametrize(
    "name, table",
    [
        ("shared_subset", "lineitem"),
        ("attach_body_code", "nation"),
        ("recode_suppliers", "nation"),
        ("enrich_ledger", "supplier"),
        ("valid_extract", "supplier"),
    ],
)
def test_one_read(spark, sf_dir, name, table):
    """A query reads a table no more often than its joins name it."""
    df = QUERIES[name](spark, sf_dir)
    named = {"lineitem": 1, "nation": 2, "supplier": 2}[table]
    assert _scans(_ran(df), table) <= named


def test_counts_without_copies_of_rows(spark, sf_dir):
    plan = _ran(QUERIES["extract_totals"](spark, sf_dir))
    assert "Expand" not in plan
