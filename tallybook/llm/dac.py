"""Directly addressable codes: chunk levels with continuation bitmaps and rank directories.

The lowest ``width`` bits of every number form the first level; numbers with
more bits have a set bit in the level's bitmap and go on in the next level. The
place of a number in the next level is the rank of its bit, so any number is
read with one look-up per level and nothing before it is decoded.

File format, little endian: ``DAC1``, then unsigned 32-bit ``width``, number of
levels, and for each level its number of chunks n, followed for each level by
n chunks of ``width / 8`` bytes, the bitmap in ``n / 64 + 1`` 64-bit words, and
the directory of as many 32-bit counts of the set bits before each word.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"


def encode(numbers: np.ndarray, width: int = 8) -> bytes:
    """Bytes of unsigned numbers below 2**32; ``width`` is 8 or 16."""
    rest = np.asarray(numbers, np.uint32)
    kind = np.dtype(f"<u{width // 8}")
    sizes, body = [], []
    while True:
        more = rest >> np.uint32(width) != 0
        packed = np.packbits(more, bitorder="little")
        words = np.zeros((len(rest) // 64 + 1) * 8, np.uint8)
        words[: len(packed)] = packed
        counts = np.bitwise_count(words.view("<u8"))
        before = np.cumsum(counts, dtype=np.uint32) - counts
        sizes.append(len(rest))
        body += [
            (rest & np.uint32(2**width - 1)).astype(kind).tobytes(),
            words.tobytes(),
            before.astype("<u4").tobytes(),
        ]
        rest = rest[more] >> np.uint32(width)
        if not len(rest):
            break
    return b"".join([MAGIC, struct.pack(f"<{len(sizes) + 2}I", width, len(sizes), *sizes), *body])


class Codes:
    """Random access to encoded numbers; the buffer is used in place."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a DAC1 buffer")
        self.width, levels = struct.unpack_from("<2I", data, 4)
        sizes = struct.unpack_from(f"<{levels}I", data, 12)
        kind, at = np.dtype(f"<u{self.width // 8}"), 12 + 4 * levels
        self.levels = []
        for n in sizes:
            words = n // 64 + 1
            chunks = np.frombuffer(data, kind, n, at)
            at += n * kind.itemsize
            bitmap = np.frombuffer(data, "<u8", words, at)
            directory = np.frombuffer(data, "<u4", words, at + 8 * words)
            at += 12 * words
            self.levels.append((chunks, bitmap, directory))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def access(self, places: np.ndarray) -> np.ndarray:
        """The numbers at any places, in any order."""
        at = np.asarray(places, np.int64)
        out, open_rows = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (chunks, bitmap, directory) in enumerate(self.levels):
            out[open_rows] |= chunks[at].astype(np.uint32) << np.uint32(level * self.width)
            word, bit = bitmap[at >> 6], (at & 63).astype(np.uint64)
            more = (word >> bit) & np.uint64(1) == 1
            at, word, bit, open_rows = at[more], word[more], bit[more], open_rows[more]
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            at = directory[at >> 6].astype(np.int64) + np.bitwise_count(below)
        return out

    def between(self, first: int, last: int) -> np.ndarray:
        """The numbers at ``first`` to ``last - 1``: one rank per level, then in a row."""
        out, rows = np.zeros(last - first, np.uint32), None
        for level, (chunks, bitmap, directory) in enumerate(self.levels):
            part = chunks[first:last].astype(np.uint32) << np.uint32(level * self.width)
            if rows is None:
                out |= part
            else:
                out[rows] |= part
            low, high = first >> 6, (last + 63) >> 6
            bits = np.unpackbits(bitmap[low:high].view(np.uint8), bitorder="little")
            bits = bits[first - 64 * low : last - 64 * low].astype(bool)
            rows = np.flatnonzero(bits) if rows is None else rows[bits]
            if not len(rows):
                break
            word = int(bitmap[low]) & ((1 << (first & 63)) - 1)
            first = int(directory[low]) + word.bit_count()
            last = first + len(rows)
        return out
