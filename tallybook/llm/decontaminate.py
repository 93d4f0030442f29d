"""Benchmark decontamination with an FM-index per shard of the corpus.

A task turns its documents into shards of words, indexes each shard, searches
all benchmark phrases backwards, locates the occurrences and merges them to the
spans to remove. Words that no benchmark item has share one symbol, and a run
of them counts once: no phrase can touch them.

Phrases are the windows of ``width`` words of an item; a shorter item is one
phrase. Null and empty texts have no words and no hits; items without words or
without an id are left out; an item listed twice counts once. Repeated documents
are handled row by row. Empty tables give empty or clean results. Columns of the
input are kept unless they are named like an added one. A benchmark too large
for one broadcast is searched in blocks of items, one pass over the rows each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm.fm_index import SEPARATOR, FMIndex
from tallybook.llm.memory import tidy
from tallybook.llm.tokens import ALNUM_WORDS, filled, word_codes

OTHER = 1  # any run of words that no item has
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ADDED = {
    "n_words": "bigint",
    "word_spans": "array<struct<first:int,last:int>>",
    "items": "array<bigint>",
}


@dataclass(frozen=True)
class Settings:
    """``block_bytes``: text of the items searched in one pass, so the bound of a broadcast.
    ``shard_words``: words after which a shard is closed; a document is never split.
    ``sample``: every so many positions keep their place."""

    width: int = 10
    block_bytes: int = 32 << 20
    shard_words: int = 2_000_000
    sample: int = 16


@dataclass
class Phrases:
    """Phrases of a block of items as symbols, by length, with the items they are from."""

    words: dict[str, int]
    by_length: list[tuple[np.ndarray, np.ndarray]]  # phrases, index into items
    items: np.ndarray


def phrases_of(items: list[tuple[int, str | None]], width: int) -> Phrases:
    words: dict[str, int] = {}
    found: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    ids = np.array(sorted({i for i, _ in items}), np.int64)
    place = {int(i): k for k, i in enumerate(ids)}
    for item, text in items:
        codes, _, distinct = word_codes(filled(pa.array([text], pa.string())), ALNUM_WORDS)
        names = distinct.to_pylist()
        own = [words.setdefault(names[c], len(words) + 2) for c in codes]
        size = min(width, len(own))
        for k in range(len(own) - size + 1) if own else ():
            found.setdefault(size, []).append((tuple(own[k : k + size]), place[item]))
    by_length = []
    for size, pairs in sorted(found.items()):
        pairs = sorted(set(pairs))
        by_length.append((np.array([p for p, _ in pairs], np.int64), np.array([i for _, i in pairs])))
    return Phrases(words, by_length, ids)


def search_shard(
    codes: np.ndarray, per_text: np.ndarray, names: pa.StringArray, phrases: Phrases, settings: Settings
) -> tuple[list[list[tuple[int, int]]], list[list[int]]]:
    """Merged word spans and the items found, for each text of a shard."""
    n = len(per_text)
    symbol_of = np.array([phrases.words.get(w, OTHER) for w in names.to_pylist()], np.int64)
    ends = np.cumsum(per_text)
    # A separator after each text, then runs of other words are closed up.
    stream = np.insert(symbol_of[codes] if len(codes) else np.empty(0, np.int64), ends, SEPARATOR)
    keep = np.ones(len(stream), bool)
    keep[1:] = (stream[1:] != OTHER) | (stream[:-1] != OTHER)
    origin = np.flatnonzero(keep)
    index = FMIndex(stream[keep], settings.sample)
    starts, stops, owners = [], [], []
    for block, owner in phrases.by_length:
        low, high = index.search(block)
        hit = np.flatnonzero(high > low)
        counts = (high - low)[hit]
        rows = np.repeat(low[hit] - np.concatenate(([0], np.cumsum(counts)))[:-1], counts)
        places = origin[index.locate(rows + np.arange(len(rows)))]
        starts.append(places)
        stops.append(places + block.shape[1])
        owners.append(np.repeat(owner[hit], counts))
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[list[int]] = [[] for _ in range(n)]
    if not starts or not sum(map(len, starts)):
        return spans, items
    start, stop, owner = map(np.concatenate, (starts, stops, owners))
    separators = ends + np.arange(n)
    text = np.searchsorted(separators, start)
    order = np.lexsort((start, text))
    text_s, start_s, stop_s = text[order], start[order], stop[order]
    # No span crosses a separator, so one running maximum serves all texts.
    reach = np.maximum.accumulate(stop_s)
    opens = np.ones(len(start_s), bool)
    opens[1:] = (start_s[1:] > reach[:-1]) | (text_s[1:] != text_s[:-1])
    at = np.flatnonzero(opens)
    base = np.concatenate(([0], separators[:-1] + 1))
    for t, a, b in zip(text_s[at], start_s[at], np.append(reach[at[1:] - 1], reach[-1])):
        spans[t].append((int(a - base[t]), int(b - base[t])))
    pairs = np.unique(np.stack((text, owner)), axis=1)
    for t, o in pairs.T:
        items[t].append(int(phrases.items[o]))
    return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _searched(docs: DataFrame, phrases: Phrases, text: str, settings: Settings) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(phrases)
    schema = docs.schema

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(filled(whole[text])), 0).to_numpy(zero_copy_only=False)
            # About six bytes a word: pieces of a batch that are one shard each.
            shard = np.cumsum(sizes) // (6 * settings.shard_words)
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(whole)]
            for a, b in zip(cuts, cuts[1:]):
                batch = whole.slice(a, b - a)
                codes, per_text, names = word_codes(filled(batch[text]), ALNUM_WORDS)
                spans, items = search_shard(codes, per_text, names, sent.value, settings)
                if batch["word_spans"].null_count < len(batch):
                    spans = [merged(s + [(x["first"], x["last"]) for x in o or ()]) for s, o in zip(spans, batch["word_spans"].to_pylist())]
                    items = [sorted({*s, *(o or ())}) for s, o in zip(items, batch["items"].to_pylist())]
                values = {
                    "n_words": pa.array(per_text, pa.int64()),
                    "word_spans": pa.array(
                        [[{"first": x, "last": y} for x, y in s] for s in spans],
                        arrow.field("word_spans").type,
                    ),
                    "items": pa.array(items, pa.list_(pa.int64())),
                }
                yield pa.RecordBatch.from_arrays(
                    [values[f.name] if f.name in values else batch[f.name] for f in arrow], schema=arrow
                )

    return docs.mapInArrow(tidy(search), schema)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """``docs`` with ``n_words``, merged ``word_spans`` [first, last) and the ``items`` found."""
    known = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    known = known.filter("i IS NOT NULL")
    size = known.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // settings.block_bytes))
    out = docs.drop(*ADDED).withColumns({c: F.lit(None).cast(t) for c, t in ADDED.items()})
    for block in range(blocks):
        part = known.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).collect()
        out = _searched(out, phrases_of([(r["i"], r["t"]) for r in part], settings.width), text, settings)
    return out


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """A text without its words in the spans, and without what stands between words of one span."""
    if not text or not spans:
        return text
    raw = text.encode()
    words = [m.span() for m in WORD.finditer(raw.translate(ALNUM_WORDS))]
    kept, at = [], 0
    for first, last in spans:
        kept.append(raw[at : words[first][0]])
        at = words[last - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def removed(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` of :func:`contaminated` with the spans cut out of the texts; ``n_hit`` counts the words."""
    schema = T.StructType(found.schema.fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.flatnonzero(pc.list_value_length(batch["word_spans"]).to_numpy(zero_copy_only=False))
            if len(hit):
                mask = np.zeros(len(batch), bool)
                mask[hit] = True
                rows = batch.filter(pa.array(mask))
                clean = [
                    without_spans(t, [(s["first"], s["last"]) for s in spans])
                    for t, spans in zip(rows[text].to_pylist(), rows["word_spans"].to_pylist())
                ]
                column = pc.replace_with_mask(batch[text], pa.array(mask), pa.array(clean, batch[text].type))
                batch = batch.set_column(batch.schema.get_field_index(text), text, column)
            yield batch

    return found.mapInArrow(tidy(cut), schema)
