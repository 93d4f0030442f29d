"""Labelled rows: held-out folds and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(folds: int, fold: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text falls into the fold that is kept from training."""
    return F.coalesce(
        F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False)
    )


def training_labels(
    labels: DataFrame, label: str, folds: int, fold: int, max_rows: int | None = None
) -> DataFrame:
    """``doc_id, y`` of the rows to learn from; distinct, without nulls.

    With ``max_rows`` the rows are thinned by a hash of the id to about that
    many, the same ones in every run.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)
    )
    rows = known.filter(~held_out(folds, fold)).distinct()
    if max_rows is None:
        return rows
    share = min(1.0, max_rows / max(1, rows.count()))
    return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
