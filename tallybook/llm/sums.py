"""Arrays added up over the partitions of a frame, in a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 8192  # numbers in one row
PARTS = "piece int, side int, part int, numbers binary"


def summed(
    rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, ...],
    kind=np.float64, sides: int = 64,
) -> np.ndarray:
    """The sum of ``partial`` (an array of one shape) over all partitions.

    Each partition's array is cut into pieces of bounded size. Pieces are added
    up in ``sides`` groups of partitions, then over the groups, in the order of
    the partitions; the driver gets one array, however many partitions there are.
    """
    size = int(np.prod(shape))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.ascontiguousarray(partial(batches), kind).ravel()
        part, starts = TaskContext.get().partitionId(), range(0, size, PIECE)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(len(starts)), pa.int32()),
                pa.array([part % sides] * len(starts), pa.int32()),
                pa.array([part] * len(starts), pa.int32()),
                pa.array([flat[a : a + PIECE].tobytes() for a in starts], pa.binary()),
            ],
            names=["piece", "side", "part", "numbers"],
        )

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = np.sum([np.frombuffer(x, kind) for x in table["numbers"].to_pylist()], axis=0, dtype=kind)
        return pa.Table.from_arrays(
            [*(table[c][:1].combine_chunks() for c in ("piece", "side", "part")), pa.array([total.tobytes()], pa.binary())],
            names=["piece", "side", "part", "numbers"],
        )

    out = np.zeros(size, kind)
    halves = rows.mapInArrow(cut, PARTS).groupBy("piece", "side").applyInArrow(add, PARTS)
    whole = halves.withColumn("part", F.col("side")).groupBy("piece").applyInArrow(add, PARTS)
    for r in whole.select("piece", "numbers").collect():
        found = np.frombuffer(r["numbers"], kind)
        out[r["piece"] * PIECE : r["piece"] * PIECE + len(found)] = found
    return out.reshape(shape)
