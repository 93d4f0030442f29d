"""Texts as sequences of units that a tokenizer codes one by one.

A unit is a word with the one space before it. Where a space stands alone
between other characters, the usual pre-tokenizers start a new piece at it, so
the ids of a text are those of its units in a row. Spaces that touch other
white space stay inside a unit, which ends at the next space that stands alone.
Each distinct unit of a stretch of texts is tokenized once. A worker remembers
short ones, within a bound in bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOUCHING = (
    r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] | [\s\x0b\x1c-\x1f\x{85}\p{Z}]"
)


#: A space without white space on either side.
ALONE = re.compile(r"(?<!\s) (?!\s)")


def split_units(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Unit codes in order, units per text, and the distinct units."""
    codes, per_text, units = distinct_units(texts)
    return codes, per_text, strings(units)


def strings(units: pa.StringArray) -> list[str]:
    return units.to_numpy(zero_copy_only=False).tolist()  # made in one go


def distinct_units(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """The same with the distinct units as they are in Arrow."""
    touching = pc.match_substring_regex(texts, TOUCHING)
    odd = touching.to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts if not odd.any() else pc.if_else(touching, "", texts), " ")
    per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    if odd.any():
        flat, per_text = _with_odd(flat, per_text, texts, odd)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary
    first = np.cumsum(per_text) - per_text
    leading, back = np.unique(codes[first], return_inverse=True)
    codes[first] = len(words) + back
    spaced = pc.binary_join_element_wise("", words, " ")
    return codes, per_text, pa.concat_arrays([spaced, words.take(pa.array(leading))])


def _with_odd(flat: pa.StringArray, per_text: np.ndarray, texts: pa.StringArray, odd: np.ndarray):
    """Words of all texts, where those of odd texts (one empty word so far) are parted at spaces that stand alone."""
    pieces, at, counts = [], 0, per_text.copy()
    ends = np.cumsum(per_text)
    for t in np.flatnonzero(odd):
        own = ALONE.split(texts[int(t)].as_py())
        pieces += [flat.slice(at, ends[t] - 1 - at), pa.array(own, pa.string())]
        at, counts[t] = int(ends[t]), len(own)
    return pa.concat_arrays([*pieces, flat.slice(at)]), counts


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes ``start, start + 1, ...`` of every stretch, in a row."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Coded:
    """Units with their ids end to end."""

    lengths: np.ndarray
    ids: np.ndarray

    def __post_init__(self) -> None:
        self.starts = np.cumsum(self.lengths) - self.lengths

    @classmethod
    def of_lists(cls, ids: list[list[int]]) -> Coded:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return cls(lengths, np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum())))

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units in a row, and ids per unit."""
        lengths = self.lengths[codes]
        return self.ids[ragged(self.starts[codes], lengths)], lengths


class Growing:
    """Numbers end to end, in room that is doubled when it is used up."""

    def __init__(self, kind) -> None:
        self.room, self.size = np.empty(1 << 10, kind), 0

    def add(self, numbers: np.ndarray) -> None:
        end = self.size + len(numbers)
        if end > len(self.room):
            room = np.empty(max(end, 2 * len(self.room)), self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : end] = numbers
        self.size = end

    @property
    def numbers(self) -> np.ndarray:
        return self.room[: self.size]


@dataclass
class Both:
    """Remembered units, then those of this stretch only."""

    starts: np.ndarray
    lengths: np.ndarray
    ids: np.ndarray
    new: Coded

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = codes < len(self.starts)
        own, other = codes[known], codes[~known] - len(self.starts)
        lengths = np.empty(len(codes), np.int64)
        lengths[known], lengths[~known] = self.lengths[own], self.new.lengths[other]
        if not len(other):
            return self.ids[ragged(self.starts[own], lengths)], lengths
        out = np.empty(int(lengths.sum()), np.int32)
        places = np.cumsum(lengths) - lengths
        for side, starts, ids in ((known, self.starts[own], self.ids), (~known, self.new.starts[other], self.new.ids)):
            out[ragged(places[side], lengths[side])] = ids[ragged(starts, lengths[side])]
        return out, lengths


#: Longest unit that is remembered, in characters, and what one costs besides its text and ids, in bytes.
LONGEST, OVERHEAD = 64, 200


class UnitStore:
    """Remembers the ids of short units a worker has met, about ``limit`` bytes of them."""

    def __init__(self, encode: Callable[[list[str]], Coded], limit: int = 64 << 20) -> None:
        self.encode, self.limit, self.used = encode, limit, 0
        self.places: dict[str, int] = {}
        self.starts, self.lengths, self.ids = Growing(np.int64), Growing(np.int32), Growing(np.int32)

    def coded(self, distinct: pa.StringArray) -> tuple[np.ndarray, Both]:
        """The place of every unit in the ids that are returned with them."""
        units, get = strings(distinct), self.places.get
        at = np.fromiter(map(get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(at < 0)
        missing = [units[k] for k in new]
        found = self.encode(missing) if missing else Coded(np.empty(0, np.int64), np.empty(0, np.int32))
        # A unit has at most four bytes a character in its text, and four for each id.
        cost = np.fromiter((OVERHEAD + 4 * len(u) if len(u) <= LONGEST else 0 for u in missing), np.int64, len(missing))
        short = np.flatnonzero(cost > 0)
        short = short[self.used + np.cumsum((cost + 4 * found.lengths)[short]) <= self.limit]
        kept = np.zeros(len(missing), bool)
        kept[short] = True
        if len(short):
            self.used += int((cost + 4 * found.lengths)[short].sum())
            before = self.starts.size
            self.places.update(zip((missing[k] for k in short), range(before, before + len(short))))
            ids, lengths = found.take(short)
            self.starts.add(self.ids.size + np.cumsum(lengths) - lengths)
            self.lengths.add(lengths)
            self.ids.add(ids)
            at[new[short]] = np.arange(before, before + len(short))
        # What is not remembered lives as long as this stretch.
        left = np.flatnonzero(~kept)
        at[new[left]] = self.starts.size + np.arange(len(left))
        ids, lengths = found.take(left)
        return at, Both(self.starts.numbers, self.lengths.numbers, self.ids.numbers, Coded(lengths, ids))


#: Letters of old scripts, which every version of the Unicode tables has as such.
LETTER = (
    r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"
    r"\x{391}-\x{3A1}\x{3A3}-\x{3CE}\x{400}-\x{481}\x{48A}-\x{4FF}"
)
#: Where an ending may be cut off, and the longest one that is.
SOLID = rf"[0-9{LETTER}]\z"
LONGEST_ENDING = 4


class StemStore(UnitStore):
    """Codes a unit as its stem and the few marks it may end with, and remembers these two.

    For tokenizers that part ``endings``, marks of ASCII, from a letter or number before
    them: the ids of such a unit are those of its stem and of its ending. Words that
    differ only in their endings are tokenized once.
    """

    def __init__(self, encode: Callable[[list[str]], Coded], endings: str, limit: int = 64 << 20) -> None:
        super().__init__(encode, limit)
        self.endings = endings

    def coded(self, whole: pa.StringArray) -> tuple[np.ndarray, Coded]:
        stems = pc.ascii_rtrim(whole, characters=self.endings)
        sizes = pc.subtract(pc.binary_length(whole), pc.binary_length(stems)).to_numpy()
        solid = pc.match_substring_regex(stems, SOLID).to_numpy(zero_copy_only=False)
        cut = solid & (sizes > 0) & (sizes <= LONGEST_ENDING)
        parts, at, starts = [pc.if_else(pa.array(cut), stems, whole)], [], np.cumsum(1 + cut) - 1 - cut
        for size in range(1, LONGEST_ENDING + 1):
            rows = np.flatnonzero(cut & (sizes == size))
            parts.append(pc.utf8_slice_codeunits(whole.take(pa.array(rows)), start=-size))
            at.append(starts[rows] + 1)
        distinct = pa.concat_arrays(parts).dictionary_encode()
        row = np.empty(len(whole) + int(cut.sum()), np.int64)  # stems and endings as they follow each other
        row[np.concatenate((starts, *at))] = distinct.indices.to_numpy()
        place, found = super().coded(distinct.dictionary)
        ids, each = found.take(place[row])
        lengths = each[starts].astype(np.int64)
        lengths[cut] += each[starts[cut] + 1]
        return np.arange(len(whole)), Coded(lengths, ids)


def joined(
    units: list[str],
    encode: Callable[[str], np.ndarray],
    opens: np.ndarray,
    block: int = 5000,
    regular: np.ndarray | None = None,
) -> Coded:
    """Ids of units, many encoded at a time as one text.

    ``opens`` tells by id which tokens start with a space. A unit has one space,
    at its start, so such tokens part the ids of a text of units. Units that are
    otherwise, or have white space at an end, are encoded alone. ``regular`` tells
    which are not, where that is known.
    """
    if regular is None:
        regular = np.array(
            [len(u) > 1 and u[0] == " " and " " not in (word := u[1:]) and word == word.strip() for u in units],
            bool,
        )
    lengths, parts = np.zeros(len(units), np.int64), []
    order = np.concatenate((np.flatnonzero(regular), np.flatnonzero(~regular)))
    count = int(regular.sum())
    for k in range(0, count, block):
        ids = encode("".join([units[i] for i in order[k : min(k + block, count)]]))
        starts = np.flatnonzero(opens[ids])
        lengths[order[k : min(k + block, count)]] = np.diff(np.append(starts, len(ids)))
        parts.append(ids)
    for i in order[count:]:
        ids = encode(units[i])
        lengths[i] = len(ids)
        parts.append(ids)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
    by_order = Coded(lengths[order], flat.astype(np.int32, copy=False))
    back = np.empty(len(units), np.int64)
    back[order] = np.arange(len(units))
    return Coded(lengths, by_order.take(back)[0])


def cuts(texts: pa.StringArray, size: int) -> list[tuple[int, int]]:
    """Bounds of stretches of texts of about ``size`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    bounds = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), len(texts)]
    return list(zip(bounds, bounds[1:]))


def encoded_texts(
    texts: pa.StringArray, store: UnitStore, slice_bytes: int = 4 << 20, piece_bytes: int = 8 << 20
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, ids, ids per text)`` over slices of a batch of about ``slice_bytes``.

    Units are made distinct over ``piece_bytes`` at a time, which bounds what is held besides
    the batch.
    """
    for low, high in cuts(texts, piece_bytes) if len(texts) else ():
        piece = texts.slice(low, high - low)
        codes, per_text, units = distinct_units(piece)
        place, coded = store.coded(units)
        del units
        codes = place[codes]
        ends = np.cumsum(per_text)
        for a, b in cuts(piece, slice_bytes):
            start = ends[a] - per_text[a]
            ids, lengths = coded.take(codes[start : ends[b - 1]])
            total = np.concatenate(([0], np.cumsum(lengths)))
            counts = np.diff(total[np.concatenate(([0], ends[a:b] - start))])
            yield low + a, low + b, ids, counts
