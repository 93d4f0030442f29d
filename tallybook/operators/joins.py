"""The join shapes of the ledger: many rows against one row of a dimension.

No broadcast is forced anywhere here. Catalyst broadcasts a side whose
estimated (or, at run time, measured) size is under the session threshold and
otherwise shuffles both sides, with skewed keys split by AQE.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` unchanged if ``key`` is unique; otherwise the job fails.

    A dimension with a repeated key would multiply ledger rows. Its rows are
    counted per key where they are read, so nothing is read twice. They are
    dealt by hash and key for that: a dealing by the key alone would do for the
    join as well, which then reads it through the count, and AQE doesn't split
    a hot key of such a join.
    """
    copies = F.count(F.lit(1)).over(Window.partitionBy(F.xxhash64(key), key))
    message = F.concat(F.lit(f"values of {key} repeated in a dimension: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    failed = F.raise_error(message).cast("boolean")
    counted = df.withColumn("_copies", copies)
    return counted.filter(F.when(F.col("_copies") > 1, failed).otherwise(True)).drop("_copies")


def attach(df: DataFrame, dimension: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Equi-join in which a row of ``df`` meets one row; a repeated key fails the job."""
    return df.join(unique_key(dimension, key), key, how)


def match_suppliers(rows: DataFrame, suppliers: DataFrame, how: str = "left") -> DataFrame:
    """Join ledger rows to the supplier master; a NULL name matches a NULL key.

    A repeated key of the master fails the job.
    """
    master = unique_key(suppliers, "Supplier").withColumnRenamed("Supplier", "_master_key")
    matched = rows.join(master, F.col("Supplier").eqNullSafe(F.col("_master_key")), how)
    return matched.drop("_master_key")


def keys_present(rows: DataFrame, key: str, *marks: Column) -> DataFrame:
    """Distinct keys of ``rows``, with aggregates, for a frame that the same query reads otherwise too.

    A hash over whole rows goes with each key. Without it column pruning would
    give this reader narrower shuffles below, and Spark could not reuse those
    of the other reader.
    """
    whole = F.bit_xor(F.xxhash64(*[f"`{c}`" for c in rows.columns]))
    return rows.groupBy(key).agg(whole.alias("_rows"), *marks).filter(F.col("_rows").isNotNull()).drop("_rows")


def restrict_to_list(
    listed: DataFrame, facts: DataFrame, key: str, present: DataFrame | None = None
) -> DataFrame:
    """``listed`` left join ``facts``: listed keys without facts give one NULL row.

    Written as an inner join plus the unmatched keys. The short list stays the
    side that can be broadcast, so one key holding much of the fact table never
    lands in one task, which a left join from the list would force. What the
    inner join finds is dealt out evenly once, and both the rows and the keys
    that are present are read from there: one pass over the facts. Where a
    narrower stored frame has the keys, ``present`` names it.
    """
    inner = listed.join(facts, key, "inner")
    if present is None:
        inner = inner.hint("rebalance")
        present = keys_present(inner, key)
    unmatched = listed.join(present.select(key).distinct(), key, "left_anti")
    return inner.unionByName(unmatched, allowMissingColumns=True)


def exclude(df: DataFrame, key: str, values: Iterable[str]) -> DataFrame:
    """Rows whose key is none of ``values``; with values given, a NULL key is dropped as well."""
    values = list(values)
    return df.filter(~F.col(key).isin(values)) if values else df
