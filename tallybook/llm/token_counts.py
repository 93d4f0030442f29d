"""Token counts by field and section, from one encoding of the whole document.

The fields of a row are joined by line ends to one document, which is encoded
once. Every token has a span of characters; an interval join with the spans of
the sections finds where it belongs. Sections are the lines of each field, with
their line ends. A token that crosses a boundary goes to the section that holds
most of its characters, of equal ones to the earliest; a token that ends inside
a character starts where that character does.

A null field is left out with its sections, an empty one is a section without
characters; a row without fields has no tokens. Texts are encoded whole, row by
row. An empty table gives an empty result; other columns are kept unless they
are named like an added one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallybook.llm.units import UnitStore, encoded_texts, joined

LIST = T.ArrayType(T.LongType())
ADDED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_crossing", T.LongType()),
        T.StructField("field_tokens", LIST),
        T.StructField("section_tokens", LIST),
        T.StructField("section_field", T.ArrayType(T.IntegerType())),
    ]
)


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> tuple[UnitStore, np.ndarray]:
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    opens = np.zeros(len(sizes), bool)
    for token, rank in ranks.items():
        sizes[rank], opens[rank] = len(token), token.startswith(b" ")
    coder = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        return np.array(coder.encode_ordinary(text), np.int32)

    return UnitStore(lambda units: joined(units, encode, opens)), sizes


def attribute(
    text: np.ndarray, token_ends: np.ndarray, section_ends: np.ndarray
) -> tuple[np.ndarray, int]:
    """Section of every token, and how many tokens cross a boundary.

    ``text`` has the bytes of a stretch of text, the ends are places in it. Both
    kinds of spans are turned to characters and joined by the sorted ends of
    the sections.
    """
    characters = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))
    end = characters[token_ends]
    start = np.concatenate(([0], end[:-1])) if len(end) else end
    bounds = characters[section_ends]
    # A token of the later bytes of a character starts where the character does.
    inside = start == end
    first = np.searchsorted(bounds, start - inside, "right")
    last = np.searchsorted(bounds, np.maximum(end, start + 1 - inside) - 1, "right")
    crossing = np.flatnonzero(last > first)
    owner = first
    for k in crossing:
        sections = np.arange(first[k], last[k] + 1)
        lows = np.maximum(np.where(sections > 0, bounds[sections - 1], 0), start[k])
        shares = np.minimum(bounds[sections], end[k]) - lows
        owner[k] = sections[np.argmax(shares)]
    return owner, len(crossing)


def counted(
    docs: DataFrame, tokenizer_path: str, pattern: str, fields: tuple[str, ...] = ("text",)
) -> DataFrame:
    """``docs`` with token counts: in all, crossing, by field (null for a null field), by section.

    ``section_field`` names each section's field by its place in ``fields``.
    """
    names = [c for c in docs.columns if c not in ADDED.names]
    docs = docs.select(*names)
    schema = T.StructType([*docs.schema.fields, *ADDED.fields])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, sizes = _encoding(tokenizer_path, pattern)
        for batch in batches:
            columns = [batch[f].to_pylist() for f in fields]
            parts = [[(k, v) for k, v in enumerate(row) if v is not None] for row in zip(*columns)]
            texts = pa.array(["\n".join(v for _, v in row) for row in parts], pa.string())
            for a, b, ids, counts in encoded_texts(texts, store):
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].slice(a, b - a) for c in names), *_counts(parts[a:b], texts[a:b], ids, counts, sizes)],
                    names=[*names, *ADDED.names],
                )

    def _counts(parts, texts, ids, counts, sizes):
        ends = np.cumsum(counts)
        lengths = sizes[ids]
        per_doc, crossings, per_field, per_section, field_of = counts.tolist(), [], [], [], []
        for row, text, a, b in zip(parts, texts.to_pylist(), ends - counts, ends):
            data = np.frombuffer(text.encode(), np.uint8)
            # Lines of each field with their ends; the line end that joins fields is the former's.
            cuts, owners, at = [], [], 0
            for place, (field, value) in enumerate(row):
                raw = np.frombuffer(value.encode() + b"\n" * (place < len(row) - 1), np.uint8)
                stops = np.flatnonzero(raw == 10) + 1
                if not len(stops) or stops[-1] < len(raw):
                    stops = np.append(stops, len(raw))
                cuts.append(at + stops)
                owners += [field] * len(stops)
                at += len(raw)
            bounds = np.concatenate(cuts) if cuts else np.empty(0, np.int64)
            owner, crossing = attribute(data, np.cumsum(lengths[a:b]), bounds)
            tokens = np.bincount(owner, minlength=len(bounds)) if len(bounds) else np.empty(0, np.int64)
            by_field = np.bincount(owners, tokens, minlength=len(fields)) if owners else np.zeros(len(fields))
            present = {k for k, _ in row}
            crossings.append(crossing)
            per_section.append(tokens)
            field_of.append(owners)
            per_field.append([int(n) if k in present else None for k, n in enumerate(by_field)])
        return [
            pa.array(per_doc, pa.int64()),
            pa.array(crossings, pa.int64()),
            pa.array(per_field, pa.list_(pa.int64())),
            pa.array(per_section, pa.list_(pa.int64())),
            pa.array(field_of, pa.list_(pa.int32())),
        ]

    return docs.mapInArrow(count, schema)
