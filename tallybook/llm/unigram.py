"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces come from a public SentencePiece file with byte fallback. Its scores are
ranks, so log scores follow Zipf's law: ``-log(rank + 1)`` less the log of their
sum. A text gets a leading space, spaces become whitespace markers, and each
stretch of markers with the characters up to the next one is segmented by
itself, since no piece goes on into a marker. The best path has the largest sum
of log scores; of equal ones, the later piece on it that is longer. A character
without a piece costs ``unknown`` below the smallest score and is written as
its bytes; so is a marker that the text itself contains, which keeps decoding
exact. Decoding joins pieces and bytes, turns markers to spaces and takes off
the leading one.

Null texts have no ids (null decoded), empty texts none (empty decoded). Texts
are coded whole and row by row; an empty table gives an empty result; other
columns are kept unless named like an added one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallybook.llm.memory import tidy
from tallybook.llm.tokens import filled
from tallybook.llm.units import Coded, UnitStore, cuts, encoded_texts

MARK = "▁"
STRETCH = 2 << 20  # bytes of text that are coded together
UNIT = re.compile(f" +[^ {MARK}]*|{MARK}|[^ {MARK}]+")
ADDED = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_byte_tokens", T.LongType()),
        T.StructField("decoded", T.StringType()),
    ]
)


class DoubleArray:
    """A trie in two arrays: ``base[s] + byte`` is the child of s if ``check`` there is s."""

    def __init__(self, pieces: list[tuple[bytes, int]]) -> None:
        pieces = sorted(pieces)
        size = 1 << 12
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        self.check[0] = 0
        pending, free_from = [(0, 0, len(pieces), 0)], 1
        while pending:
            state, low, high, depth = pending.pop()
            if low < high and len(pieces[low][0]) == depth:
                self.value[state] = pieces[low][1]
                low += 1
            starts, at = [], low
            while at < high:
                byte, first = pieces[at][0][depth], at
                while at < high and pieces[at][0][depth] == byte:
                    at += 1
                starts.append((byte, first, at))
            if not starts:
                continue
            bytes_ = np.array([s[0] for s in starts])
            base = self._place(bytes_, free_from)
            self.base[state] = base
            self.check[base + bytes_] = state
            pending += [(base + b, first, last, depth + 1) for b, first, last in starts]
            taken = self.check[free_from : free_from + 512] >= 0
            free_from += int(np.argmin(taken)) if not taken.all() else len(taken)
        # Any state may be asked for any byte.
        self._grow(256)

    def _place(self, bytes_: np.ndarray, at: int) -> int:
        """The first base from ``at`` on that has a free slot for each byte."""
        while True:
            while at + 4096 + 512 > len(self.check):
                self._grow()
            slots = at + np.flatnonzero(self.check[at : at + 4096] < 0)
            bases = slots[slots > bytes_[0]] - bytes_[0]
            fits = (self.check[bases[:, None] + bytes_] < 0).all(axis=1)
            if fits.any():
                return int(bases[np.argmax(fits)])
            at += 4096

    def _grow(self, by: int | None = None) -> None:
        by = by or len(self.check)
        self.base = np.concatenate((self.base, np.zeros(by, np.int32)))
        self.check = np.concatenate((self.check, np.full(by, -1, np.int32)))
        self.value = np.concatenate((self.value, np.full(by, -1, np.int32)))

    def step(self, states: np.ndarray, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children, and whether there is one."""
        to = self.base[states] + bytes_
        return to, (self.check[to] == states) & (to > 0)


@dataclass
class Model:
    trie: DoubleArray
    scores: np.ndarray  # by id
    surface: list[bytes]  # by id, markers as spaces
    byte_ids: np.ndarray  # by byte
    unknown: float

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, path: str, unknown: float = 10.0) -> Model:
        import sentencepiece

        source = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, surface = [], np.full(256, -1, np.int32), []
        ranks = np.zeros(source.get_piece_size())
        for i in range(source.get_piece_size()):
            name = source.id_to_piece(i)
            if source.is_byte(i):
                byte_ids[int(name[3:5], 16)] = i
                surface.append(bytes([int(name[3:5], 16)]))
            elif source.is_control(i) or source.is_unknown(i) or source.is_unused(i):
                surface.append(b"")
            else:
                if MARK in name.lstrip(MARK):
                    raise ValueError(f"piece {i} goes on into a marker")
                pieces.append((name.encode(), i))
                ranks[i] = -source.get_score(i)
                surface.append(name.replace(MARK, " ").encode())
        if (byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        own = np.array([i for _, i in pieces])
        scores = np.full(len(ranks), -np.inf)
        scores[own] = -np.log(ranks[own] + 1) - np.log(np.sum(1 / (ranks[own] + 1)))
        return cls(DoubleArray(pieces), scores, surface, byte_ids, float(scores[own].min() - unknown))

    @property
    def is_byte(self) -> np.ndarray:
        """By id, whether it stands for a byte."""
        return np.isin(np.arange(len(self.surface)), self.byte_ids)

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.surface[i] for i in ids]).decode()[1:]

    def segmented(self, strings: list[bytes], block: int = 32_768) -> list[list[int]]:
        """Best ids of each string; all strings of a block advance together."""
        out: list[list[int]] = [[]] * len(strings)
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            # Strings of like length, and no more than a bounded table of cells.
            longest = max(8, int(lengths[order[at]] * 5 // 4))
            count = max(1, min(block, (1 << 20) // (longest + 1)))
            rows = order[at : at + count]
            rows = rows[lengths[rows] <= longest]
            at += len(rows)
            for row, ids in zip(rows, self._block([strings[r] for r in rows], lengths[rows])):
                out[row] = ids
        return out

    def _block(self, strings: list[bytes], lengths: np.ndarray) -> list[list[int]]:
        n, width = len(strings), int(lengths.max(initial=0))
        data = np.zeros((n, width + 1), np.uint8)
        flat = np.frombuffer(b"".join(strings), np.uint8)
        data[np.arange(width + 1) < lengths[:, None]] = flat
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        piece = np.full((n, width + 1), -1, np.int32)
        back = np.zeros((n, width + 1), np.int32)
        for s in range(width):
            rows = np.flatnonzero((best[:, s] > -np.inf) & (s < lengths))
            if not len(rows):
                continue
            lead = data[rows, s]
            size = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(len(rows), bool)
            live, state, at = np.arange(len(rows)), np.zeros(len(rows), np.int32), s
            while len(live):
                state, found = self.trie.step(state, data[rows[live], at].astype(np.int32))
                found &= at < lengths[rows[live]]
                live, state = live[found], state[found]
                at += 1
                value = self.trie.value[state]
                ends = value >= 0
                whole, value = live[ends], value[ends]
                single[whole[size[whole] == at - s]] = True
                self._relax(best, piece, back, rows[whole], s, np.full(len(whole), at), self.scores[value], value)
            lone = np.flatnonzero(~single)
            if len(lone):
                self._relax(
                    best, piece, back, rows[lone], s, s + size[lone],
                    np.full(len(lone), self.unknown), np.full(len(lone), -1, np.int32),
                )
        places, owners, values = [], [], []
        rows, at = np.arange(n), lengths.copy()
        while True:
            open_ = at > 0
            rows, at = rows[open_], at[open_]
            if not len(rows):
                break
            start, value = back[rows, at].astype(np.int64), piece[rows, at]
            known = value >= 0
            places.append(start[known])
            owners.append(rows[known])
            values.append(value[known])
            for r, a, b in zip(rows[~known], start[~known], at[~known]):
                places.append(np.arange(a, b))
                owners.append(np.full(b - a, r))
                values.append(self.byte_ids[data[r, a:b]])
            at = start
        if not places:
            return [[] for _ in range(n)]
        place, owner, value = map(np.concatenate, (places, owners, values))
        inner = np.argsort(owner * (width + 1) + place, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=n))
        ids = value[inner].tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    @staticmethod
    def _relax(best, piece, back, rows, start, ends, gain, value) -> None:
        """A path over one more piece, where it is better than what reached the place before."""
        total = best[rows, start] + gain
        better = total > best[rows, ends]
        rows, ends = rows[better], ends[better]
        best[rows, ends], piece[rows, ends], back[rows, ends] = total[better], value[better], start

    def coded(self, units: list[str]) -> Coded:
        """Ids of units of :mod:`tallybook.llm.units` with their leading spaces, or of whole texts."""
        parts, owner = [], []
        for k, unit in enumerate(units):
            plain = unit.count(" ", 1) == 0 and MARK not in unit
            found = [unit] if plain and unit else UNIT.findall(unit)
            parts += found
            owner += [k] * len(found)
        literal = self.byte_ids[list(MARK.encode())].tolist()
        strings = [b"" if p == MARK else p.replace(" ", MARK).encode() for p in parts]
        out: list[list[int]] = [[] for _ in units]
        for k, p, ids in zip(owner, parts, self.segmented(strings)):
            out[k] = out[k] + (literal if p == MARK else ids)
        return Coded.of_lists(out)


def encoded(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens``, ``n_byte_tokens`` and the text ``decoded`` from the ids.

    The trie is built once on the driver; its size is that of the vocabulary.
    """
    model = docs.sparkSession.sparkContext.broadcast(Model.load(model_path))
    names = [c for c in docs.columns if c not in ADDED.names]
    docs = docs.select(*names)
    schema = T.StructType([*docs.schema.fields, *ADDED.fields])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        # Kept with the model by the worker, over its tasks.
        store = own.__dict__.setdefault("store", UnitStore(own.coded, 40 << 20))
        for batch in batches:
            whole = filled(batch[text])
            for low, high in cuts(whole, STRETCH) if len(whole) else ():
                yield from coded(own, store, batch.slice(low, high - low), whole.slice(low, high - low))

    def coded(own: Model, store: UnitStore, batch: pa.RecordBatch, whole: pa.StringArray) -> Iterator[pa.RecordBatch]:
        nulls = batch[text].is_null().to_numpy(zero_copy_only=False)
        # The leading space is part of the first unit; an empty text gets none.
        spaced = pc.binary_join_element_wise(pa.scalar(" "), whole, pa.scalar(""))
        texts = pc.if_else(pc.equal(whole, ""), whole, spaced)
        for a, b, ids, counts in encoded_texts(texts, store, slice_bytes=STRETCH // 2, piece_bytes=2 * STRETCH):
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], ends)), pa.int32(), mask=np.append(nulls[a:b], False)),
                pa.array(ids, pa.int32()),
            )
            in_bytes = np.concatenate(([0], np.cumsum(own.is_byte[ids])))
            decoded = [
                None if null else own.decode(ids[e - c : e].tolist())
                for null, e, c in zip(nulls[a:b], ends.tolist(), counts.tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c].slice(a, b - a) for c in names), lists, pa.array(counts), pa.array(in_bytes[ends] - in_bytes[ends - counts]), pa.array(decoded, pa.string())],
                names=[*names, *ADDED.names],
            )

    return docs.mapInArrow(tidy(code), schema)
