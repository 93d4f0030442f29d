"""Whitening of embeddings on the leading eigenvectors of their covariance.

Entries are made whole numbers, ``floor(steps * c) + shift``. The covariance is
over the list of distinct vectors: sums per dimension first, exact, then the
products of centred vectors, added up over partitions in a tree. Its leading
eigenpairs come from :mod:`tallybook.llm.spectrum` on the driver, which holds
matrices of the size of a vector only. Rows are projected where they lie.

Vectors that are null or hold a null, a NaN or an infinite entry are left out.
A component whose eigenvalue is zero to rounding can't be scaled to one and has
no rows, so equal vectors alone, or an empty table, give none. Vectors of
another length are a list of their own, with its own components; an empty one
has none. Repeated rows get a row each per component; null ids stay null. Entries
beyond 2^53 steps are held there, and a deviation beyond 64 bits is null. Other
columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.spectrum import leading
from tallybook.llm.storage import stored
from tallybook.llm.sums import summed

WHITENED = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double"
LIMIT = float(1 << 53)
LOW_BITS = 26  # sums are kept in two parts, so that no part overflows


@dataclass(frozen=True)
class Settings:
    steps: int = 64
    shift: int = 1_000_000
    components: int = 16


def whole_numbers(rows: DataFrame, settings: Settings, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the rows whose vector is complete and finite; ``x`` is without the shift."""
    entries = F.col(embedding).cast("array<double>")
    finite = F.forall(
        entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
    )
    held = lambda c: F.greatest(F.least(c * settings.steps, F.lit(LIMIT)), F.lit(-LIMIT))
    return rows.filter(F.col(embedding).isNotNull() & finite).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(entries, lambda c: F.floor(held(c))).alias("x")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _times_n_less_sums(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S`` exactly; as Python integers where 64 bits could be too few."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(apart: np.ndarray) -> list[int | None]:
    """Row sums of squares, exactly; None beyond 64 bits."""
    if float(np.abs(apart).max(initial=0)) ** 2 * apart.shape[1] < 1 << 62:
        return (apart * apart).sum(axis=1).tolist()
    exact = (apart.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


@dataclass
class Fitted:
    """Number and sums of the distinct vectors, and the whitening of centred ones."""

    n: int
    sums: list[int]
    scaled: np.ndarray  # eigenvectors as columns, over the roots of their eigenvalues
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (_times_n_less_sums(x, self.n, self.sums) / self.n).astype(np.float64)


def fit(distinct: DataFrame, width: int, settings: Settings) -> Fitted:
    """From the list of distinct vectors ``x`` of one length."""

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((2, width + 1), np.int64)
        for batch in batches:
            x = _matrix(batch["x"], width)
            out[0, :width] += (x >> LOW_BITS).sum(axis=0)
            out[1, :width] += (x & ((1 << LOW_BITS) - 1)).sum(axis=0)
            out[1, width] += len(x)
        return out

    high, low = summed(distinct, sums, (2, width + 1), np.int64).tolist()
    n = low[width]
    own = Fitted(n, [(h << LOW_BITS) + v for h, v in zip(high[:width], low[:width])], np.empty((width, 0)), np.empty(0))

    def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((width, width))
        for batch in batches:
            d = own.centred(_matrix(batch["x"], width))
            out += d.T @ d
        return out

    covariance = summed(distinct, products, (width, width)) / n
    values, vectors = leading(covariance, settings.components)
    trace = float(np.trace(covariance))
    some = values > width * np.finfo(float).eps * trace
    own.scaled = vectors[:, some] / np.sqrt(values[some])
    own.explained = values[some] / trace if some.any() else values[some]
    return own


def identity_error(distinct: DataFrame, width: int, own: Fitted) -> float:
    """Largest entry of the covariance of the whitened list, less the identity."""
    count = own.scaled.shape[1]

    def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((count, count))
        for batch in batches:
            w = own.centred(_matrix(batch["x"], width)) @ own.scaled
            out += w.T @ w
        return out

    return float(np.abs(summed(distinct, products, (count, count)) / own.n - np.eye(count)).max())


def projected(rows: DataFrame, width: int, own: Fitted) -> DataFrame:
    """A row for each vector and component."""
    count = own.scaled.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["x"], width)
            apart = _times_n_less_sums(x, own.n, own.sums)
            each = np.repeat(np.arange(len(x)), count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"].take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(each), own.n), pa.int64()),
                    pa.array(_squares(apart), pa.int64()).take(pa.array(each)),
                    pa.array(((apart / own.n).astype(np.float64) @ own.scaled).ravel()),
                    pa.array(np.tile(own.explained, len(x))),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
            )

    return rows.mapInArrow(project, WHITENED)


def whitened(
    rows: DataFrame, settings: Settings = Settings(), vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """``vec_id component n deviation whitened explained identity_error`` of all complete vectors."""
    own = stored(whole_numbers(rows, settings, vec_id, embedding), "vectors")
    distinct = stored(own.select("x").distinct(), "distinct-vectors")
    # Lengths of vectors; one in any ordinary table.
    widths = sorted(r[0] for r in distinct.filter(F.size("x") > 0).select(F.size("x")).distinct().collect())
    parts = []
    for width in widths:
        some = F.size("x") == width
        fitted = fit(distinct.filter(some), width, settings)
        if fitted.scaled.shape[1]:
            error = identity_error(distinct.filter(some), width, fitted)
            parts.append(projected(own.filter(some), width, fitted).withColumn("identity_error", F.lit(error)))
    if not parts:
        return own.sparkSession.createDataFrame([], WHITENED + ", identity_error double")
    return reduce(DataFrame.unionByName, parts)
