"""Stable row ranks: the position after a sort, without ties.

Every order passed in ends with a unique key, which stands for the order the
rows had before the sort.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of a part of a large order, on average, and rows sampled of each part.
_PART_ROWS = 100_000
_SAMPLES = 25


class SortKey(NamedTuple):
    """A column to sort by. Missing values come last in both directions."""

    name: str
    down: bool


def ascending(name: str) -> SortKey:
    return SortKey(name, False)


def descending(name: str) -> SortKey:
    return SortKey(name, True)


def sort_columns(keys: list[SortKey]) -> list[Column]:
    return [
        F.col(k.name).desc_nulls_last() if k.down else F.col(k.name).asc_nulls_last() for k in keys
    ]


def global_rank(df: DataFrame, keys: list[SortKey], name: str) -> DataFrame:
    """Rank a frame that is keyed by a closed list.

    A window without partition keys runs in one task. That is what a frame of
    one row per paying body (a few hundred), per successor unit or per file
    wants. Frames keyed by supplier have no such bound: use :func:`range_rank`.
    """
    position = F.row_number().over(Window.orderBy(*sort_columns(keys)))
    return df.withColumn(name, position.cast("long"))


def range_rank(
    df: DataFrame, keys: list[SortKey], name: str, part_rows: int = _PART_ROWS, samples: int = _SAMPLES
) -> DataFrame:
    """The same rank for frames of any size.

    Splitters over the whole order, all sort keys together, cut it into parts.
    They come from a sample by hash of the rows, one in ``part_rows / samples``;
    every ``samples``-th of it is a splitter. So the number of parts follows
    the number of rows, and neither a shared value nor a common beginning of
    names can fill a part. A row's rank is its place in its part plus the rows
    of all earlier parts. Splitters come from a scalar subquery, so nothing
    runs before the query does. A part is found through a list of every n-th
    splitter first, n being the root of their number.
    """
    names = [f"`{k.name}`" for k in keys]
    row = f"struct({', '.join(names)})"
    drawn = f"pmod(xxhash64({', '.join(names)}), {max(1, part_rows // samples)}) = 0"
    compared = f"CASE WHEN {_before('x', 'y', keys)} THEN -1 WHEN {_before('y', 'x', keys)} THEN 1 ELSE 0 END"
    sample = f"array_sort(collect_list(CASE WHEN {drawn} THEN {row} END), (x, y) -> {compared})"
    step = "CAST(greatest(1, ceil(sqrt(size(cuts)))) AS INT)"
    splitters = (
        df.agg(F.expr(f"filter({sample}, (x, i) -> i % {samples} = {samples - 1})").alias("cuts"))
        .selectExpr(f"struct(cuts, {step} AS step, filter(cuts, (x, i) -> i % {step} = {step} - 1) AS coarse)")
        .scalar()
    )

    def cuts_before(some: str) -> str:
        return f"size(filter({some}, cut -> {_before('cut', row, keys)}))"

    first = f"{cuts_before('_cuts.coarse')} * _cuts.step"
    inner = "slice(_cuts.cuts, _first + 1, _cuts.step)"
    placed = (
        df.select("*", splitters.alias("_cuts"))
        .selectExpr("*", f"{first} AS _first")
        .selectExpr(*[f"`{c}`" for c in df.columns], f"_first + {cuts_before(inner)} AS _part")
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*sort_columns(keys)))
    # One row for each hundred thousand.
    ranked = placed.join(F.broadcast(starts), "_part")
    return ranked.select(*[f"`{c}`" for c in df.columns], (F.col("_start") + inside).cast("long").alias(name))


def _before(x: str, y: str, keys: list[SortKey]) -> str:
    """SQL: whether struct ``x`` stands before struct ``y``; missing values come last."""
    out = "false"
    for key in reversed(keys):
        a, b = f"{x}.`{key.name}`", f"{y}.`{key.name}`"
        apart = f"coalesce({a} {'>' if key.down else '<'} {b}, false)"
        out = f"(({a} IS NOT NULL AND {b} IS NULL) OR {apart} OR ({a} <=> {b} AND {out}))"
    return out
