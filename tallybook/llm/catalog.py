"""The registered queries of the subpackage over one folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallybook.llm import queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in vars(q).items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(q.ORACLE_SQL)
