"""A supplier with half of the ledger, in the record-level joins."""

from __future__ import annotations

import pytest
from frames import master
from pyspark.sql import functions as F

from tallybook.plans import collate, enrich
from tallybook.schemas import INVOICES

SMALL_PIECES = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def small_pieces(spark):
    for key, value in SMALL_PIECES.items():
        spark.conf.set(key, value)
    yield
    for key in SMALL_PIECES:
        spark.conf.unset(key)


@pytest.mark.parametrize("join", [enrich.enrich_ledger, enrich.valid_extract])
def test_a_hot_supplier_is_split(spark, small_pieces, join):
    names = [f"S{k}" for k in range(200)]
    number = F.col("id") % 200
    hot = F.when(F.col("id") % 2 == 0, "S0").otherwise(F.concat(F.lit("S"), number.cast("string")))
    raw = spark.range(0, 60_000, 1, 16).select(
        F.lit("BODY").alias("CCGName"),
        F.lit("1").alias("CCGCode"),
        F.concat(F.lit("type "), F.col("id").cast("string")).alias("ExpenseType"),
        F.lit("area").alias("ExpenseArea"),
        hot.alias("Supplier"),
        F.lit(30_000).cast("decimal(18,2)").alias("Amount"),
    )
    ledger = collate.threshold_flag(collate.sign_split(raw)).select(*INVOICES.names)
    joined = join(ledger, master(spark, [{"Supplier": n} for n in names]))
    assert len(joined.collect()) == 60_000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan
