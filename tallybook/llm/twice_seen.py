"""Two Bloom filters over the hashes of a table: seen once, and seen twice.

Tasks turn the hashes of their rows into places of bits, a bounded number of
hashes at a time; the places go, block of the filter by block, to the task that
merges the block. A bit is in the first filter if any chunk has it, in the
second if two chunks have it or one chunk has a hash of it twice. So a hash that
two rows have is always found in the second filter, and one that a single row
has is found there about as often as in any Bloom filter of that load.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PLACES = "block int, once binary, twice binary"
PROBES = 4
BLOCK_BITS = 20  # a block of the filter; smaller filters are one block


def filter_bits(hashes: int, per_hash: int, most: int) -> int:
    """Bits of a filter for so many hashes: a power of two, ``most`` at the largest."""
    wanted = 1 << max(16, (max(1, hashes) * per_hash - 1).bit_length())
    return min(wanted, 1 << (most.bit_length() - 1))


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of each hash's bits, one row a hash."""
    x = hashes[:, None] + np.arange(1, PROBES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & np.uint64(bits - 1)


def _by_block(places: np.ndarray, block: int) -> dict[int, bytes]:
    """Sorted places inside each block, as 32-bit numbers."""
    number = (places >> np.uint64(block)).astype(np.int64)
    starts = np.flatnonzero(np.diff(number, prepend=-1))
    inside = (places & np.uint64((1 << block) - 1)).astype(np.uint32)
    return {int(number[a]): inside[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(places)])}


def seen(hashes: DataFrame, bits: int, twice: bool = True, chunk: int = 1 << 21) -> np.ndarray:
    """The filter, as bytes, of ``hashes`` (one column of arrays; a row has a hash once).

    The driver gets ``bits / 8`` bytes.
    """
    (column,) = hashes.columns
    block = min(BLOCK_BITS, bits.bit_length() - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        size = 0
        for batch in batches:
            # A batch may itself have many hashes: cut it as well.
            flat = batch[column].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(flat), chunk):
                waiting.append(flat[k : k + chunk])
                size += len(waiting[-1])
                if size >= chunk:
                    yield placed(np.concatenate(waiting))
                    waiting, size = [], 0
        if size:
            yield placed(np.concatenate(waiting))

    def placed(flat: np.ndarray) -> pa.RecordBatch:
        distinct, counts = np.unique(flat, return_counts=True)
        once = _by_block(np.unique(_places(distinct, bits)), block)
        again = _by_block(np.unique(_places(distinct[counts > 1], bits)), block) if twice else {}
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(once), pa.int32()),
                pa.array(list(once.values()), pa.binary()),
                pa.array([again.get(b, b"") for b in once], pa.binary()),
            ],
            names=["block", "once", "twice"],
        )

    def merge(table: pa.Table) -> pa.Table:
        first, second = np.zeros(1 << block, bool), np.zeros(1 << block, bool)
        for once, again in zip(table["once"], table["twice"]):
            at = np.frombuffer(once.as_buffer(), np.uint32)
            second[at[first[at]]] = True
            first[at] = True
            second[np.frombuffer(again.as_buffer(), np.uint32)] = True
        packed = np.packbits(second if twice else first, bitorder="little").tobytes()
        return pa.table({"block": table["block"][:1], "bits": pa.array([packed], pa.binary())})

    merged = hashes.mapInArrow(place, PLACES).groupBy("block").applyInArrow(merge, "block int, bits binary")
    out = np.zeros(max(1, bits // 8), np.uint8)
    for r in merged.toLocalIterator():
        out[r["block"] << (block - 3) :][: len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def may_hold(filter_bytes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter; never wrong about one that is."""
    at = _places(hashes, 8 * len(filter_bytes))
    bit = np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
    return ((filter_bytes[(at >> np.uint64(3)).astype(np.int64)] & bit) != 0).all(axis=1)
