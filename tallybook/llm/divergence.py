r"""Source divergence audit: how the words of a source differ from those of its language.

Terms are runs of ASCII letters, in lower case, and characters from U+0080 on.
A language keeps the terms that at least ``documents`` of its documents hold.
Every (lang, source) group and every language gives a kept term the share
``p = 1 + floor(scale (c + smooth) / (N + smooth V))``, c being its occurrences
there, N their sum over the V kept terms; in whole numbers, by long division, so
nothing overflows below 9e15 occurrences.

* :func:`distances`: sum over all kept terms of ``|p - q|`` for each pair of
  groups of a language, by blocks of terms; partial sums leave the tasks.
* :func:`raised`: the terms of a group with ``p > q``, q the language's, by
  falling ``p - q``. A term whose group count is no lower, whose language count
  is no higher and that comes earlier in UTF-8 stands before another one for
  sure. Partitions keep the terms that fewer than ``top`` others dominate so (a
  skyband; the first ``top`` terms are always in it), skybands are merged in
  salted parts of a group, and what is left is ranked exactly.

Null lang, source and text are read as ''. A row is a document, repeated ones
count again. Groups without a term have distances but no terms; where a language
keeps no term, its distances are 0. Ties go by UTF-8. An empty table gives no
rows. The driver holds one row per group, of which the report itself has the
square; other columns of the input are not carried.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.storage import stored
from tallybook.llm.tokens import filled, word_codes

#: Bytes to lower-case bytes; everything that is no letter becomes a space.
LETTERS = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
COUNTED = "lang string, source string, term string, n bigint, docs bigint"
BAND = "lang string, source string, term string, n bigint, lang_n bigint"
PAIRED = "lang string, a string, b string, value bigint"


@dataclass(frozen=True)
class Settings:
    """``scale``: a number below 1000, times a power of 1000; ``salts``: parts of a group whose skybands
    are merged apart; ``cells``: entries of the table of terms and sources that a task has at a time."""

    documents: int = 30
    scale: int = 1_000_000_000
    smooth: int = 5
    top: int = 50
    salts: int = 4
    cells: int = 1 << 21

    def __post_init__(self) -> None:
        left = self.scale
        while left >= 1000 and left % 1000 == 0:
            left //= 1000
        if not 0 < left < 1000:
            raise ValueError("scale must be a number below 1000, times a power of 1000")


def counted(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang source term n docs`` over all documents; a null term's ``docs`` are the group's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, per_text, names = word_codes(filled(batch["text"]), LETTERS)
            groups = pa.StructArray.from_arrays([filled(batch["lang"]), filled(batch["source"])], ["lang", "source"])
            keys: dict[tuple, int] = {}
            own = np.array([keys.setdefault((g["lang"], g["source"]), len(keys)) for g in groups.to_pylist()], np.int64)
            size = max(1, len(names))
            owner = np.repeat(np.arange(len(batch)), per_text)
            # Once per document and term, then per group and term.
            cells, n = np.unique(owner * size + codes, return_counts=True)
            at, inverse, docs_of = np.unique(own[cells // size] * size + cells % size, return_inverse=True, return_counts=True)
            totals = np.bincount(inverse, n, minlength=len(at)).astype(np.int64)
            group = np.concatenate((at // size, np.arange(len(keys))))
            langs, sources = (pa.array([k[f] for k in keys], pa.string()).take(pa.array(group)) for f in (0, 1))
            terms = pa.concat_arrays([names.take(pa.array(at % size)).cast(pa.string()), pa.nulls(len(keys), pa.string())])
            yield pa.RecordBatch.from_arrays(
                [
                    langs,
                    sources,
                    terms,
                    pa.array(np.concatenate((totals, np.zeros(len(keys), np.int64)))),
                    pa.array(np.concatenate((docs_of, np.bincount(own, minlength=len(keys))))),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

    named = docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    return named.mapInArrow(count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, settings: Settings) -> DataFrame:
    """``lang term lang_n groups`` of the kept terms; ``groups`` lists the sources that have the term."""
    per_term = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(
        F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("groups")
    )
    return per_term.filter(F.col("docs") >= settings.documents).drop("docs")


@dataclass
class Totals:
    """Of every language: its kept terms and their occurrences, and those of its sources, by name."""

    terms: dict[str, int]
    occurrences: dict[str, int]
    sources: dict[str, dict[str, int]]

    @classmethod
    def of(cls, counts: DataFrame, kept: DataFrame) -> Totals:
        own = cls({}, {}, defaultdict(dict))
        # One row per group and per language.
        for r in counts.select("lang", "source").distinct().orderBy("lang", "source").collect():
            own.sources[r["lang"]][r["source"]] = 0
        for r in kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("n")).collect():
            own.terms[r["lang"]], own.occurrences[r["lang"]] = r["v"], r["n"]
        each = kept.select("lang", F.explode("groups").alias("g")).groupBy("lang", "g.source").agg(F.sum("g.n").alias("n"))
        for r in each.collect():
            own.sources[r["lang"]][r["source"]] = r["n"]
        return own

    def divisor(self, lang: str, source: str | None, settings: Settings) -> int:
        n = self.occurrences[lang] if source is None else self.sources[lang][source]
        return n + settings.smooth * self.terms[lang]


def share(count, divisor, settings: Settings):
    """``1 + floor(scale (count + smooth) / divisor)`` of arrays or numbers, a thousandth at a time."""
    rest, out, scale = count + settings.smooth, 0, settings.scale
    while scale > 1:
        step = min(1000, scale)
        rest = rest * step
        out = out * step + rest // divisor
        rest, scale = rest % divisor, scale // step
    return out + 1


def _tables(batch: pa.RecordBatch, totals: Totals, settings: Settings):
    """``(lang, terms, lang counts, source codes, term codes, counts)`` of a batch's languages, in blocks of terms."""
    langs = batch["lang"].to_pylist()
    for lang in dict.fromkeys(langs):
        rows = batch.filter(pa.array([x == lang for x in langs]))
        block = max(1, settings.cells // max(1, len(totals.sources[lang])))
        for k in range(0, len(rows), block):
            some = rows.slice(k, block)
            groups = some["groups"].flatten()
            coded = groups.field("source").dictionary_encode()
            place = {name: i for i, name in enumerate(totals.sources[lang])}
            to_code = np.array([place[s] for s in coded.dictionary.to_pylist()], np.int64)
            sizes = some["groups"].value_lengths().to_numpy(zero_copy_only=False)
            yield (
                lang,
                some["term"],
                some["lang_n"].to_numpy(zero_copy_only=False),
                to_code[coded.indices.to_numpy(zero_copy_only=False)],
                np.repeat(np.arange(len(some)), sizes),
                groups.field("n").to_numpy(zero_copy_only=False),
            )


def distances(kept: DataFrame, totals: Totals, settings: Settings) -> DataFrame:
    """``lang a b value`` of every two groups of a language, in both directions."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, terms, _, source, term, n in _tables(batch, totals, settings):
                own = totals.sources[lang]
                divisors = np.array([totals.divisor(lang, s, settings) for s in own], np.int64)
                table = np.zeros((len(own), len(terms)), np.int64)
                table[source, term] = n
                table = share(table, divisors[:, None], settings)
                total = sums.setdefault(lang, np.zeros((len(own), len(own)), np.int64))
                for k in range(len(own)):
                    total[k] += np.abs(table - table[k]).sum(axis=1)
        for lang, total in sums.items():
            names = list(totals.sources[lang])
            for k, name in enumerate(names):
                others = [j for j in range(len(names)) if j != k]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(others), pa.string()),
                        pa.array([name] * len(others), pa.string()),
                        pa.array([names[j] for j in others], pa.string()),
                        pa.array(total[k][others], pa.int64()),
                    ],
                    names=["lang", "a", "b", "value"],
                )

    found = kept.select("lang", "term", "lang_n", "groups").mapInArrow(add, PAIRED)
    # A language without a kept term has no table: its pairs are 0.
    spark = kept.sparkSession
    bare = [(lang, list(own)) for lang, own in totals.sources.items() if lang not in totals.terms]
    names = spark.createDataFrame(bare, "lang string, names array<string>").select("lang", F.explode("names").alias("a"), "names")
    zero = names.select("lang", "a", F.explode("names").alias("b"), F.lit(0).cast("long").alias("value")).filter("a <> b")
    return found.unionByName(zero).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def skyband(count: np.ndarray, lang_count: np.ndarray, terms: np.ndarray, top: int, block: int = 256) -> np.ndarray:
    """Places of the terms that fewer than ``top`` others dominate.

    In the order of falling count, rising language count and UTF-8 a term comes after
    those that dominate it. The first ``top`` of these are in the skyband themselves, so
    comparing with what has been kept is enough; rows of a block are compared with it first.
    """
    _, place = np.unique(terms, return_inverse=True)
    order = np.lexsort((place, lang_count, -count))
    lang_count, place = lang_count[order], place[order]
    kept = np.empty(0, np.int64)
    for k in range(0, len(order), block):
        own = np.arange(k, min(k + block, len(order)))
        before = (lang_count[kept] <= lang_count[own, None]) & (place[kept] < place[own, None])
        own = own[before.sum(axis=1) < top]
        both = np.concatenate((kept, own))
        before = (lang_count[both] <= lang_count[own, None]) & (place[both] < place[own, None]) & (both < own[:, None])
        kept = np.concatenate((kept, own[before.sum(axis=1) < top]))
    return order[kept]


def _bytes(terms: pa.Array) -> np.ndarray:
    """Terms as bytes, which sort like UTF-8."""
    return np.array([t.encode() for t in terms.to_pylist()], object)


def _band_rows(lang: str, source: str, terms: np.ndarray, n: np.ndarray, lang_n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * len(n), pa.string()),
            pa.array([source] * len(n), pa.string()),
            pa.array([t.decode() for t in terms], pa.string()),
            pa.array(n, pa.int64()),
            pa.array(lang_n, pa.int64()),
        ],
        names=["lang", "source", "term", "n", "lang_n"],
    )


def raised(kept: DataFrame, totals: Totals, settings: Settings) -> DataFrame:
    """``lang source item value rank`` of the terms a group has more of than its language, the first ``top``."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands: dict[tuple[str, str], tuple] = {}
        for batch in batches:
            for lang, terms, lang_n, source, term, n in _tables(batch, totals, settings):
                names, spelled = list(totals.sources[lang]), _bytes(terms)
                divisors = np.array([totals.divisor(lang, s, settings) for s in names], np.int64)
                more = share(n, divisors[source], settings) > share(lang_n, totals.divisor(lang, None, settings), settings)[term]
                for code in np.unique(source[more]):
                    rows = np.flatnonzero(more & (source == code))
                    new = (spelled[term[rows]], n[rows], lang_n[term[rows]])
                    old = bands.get((lang, names[code]))
                    both = new if old is None else tuple(map(np.concatenate, zip(old, new)))
                    stay = skyband(both[1], both[2], both[0], settings.top)
                    bands[lang, names[code]] = tuple(x[stay] for x in both)
        for (lang, source_name), band in bands.items():
            yield _band_rows(lang, source_name, *band)

    def merge(table: pa.Table) -> pa.Table:
        terms = _bytes(table["term"])
        n, lang_n = (table[c].to_numpy() for c in ("n", "lang_n"))
        stay = skyband(n, lang_n, terms, settings.top)
        own = _band_rows(table["lang"][0].as_py(), table["source"][0].as_py(), terms[stay], n[stay], lang_n[stay])
        return pa.Table.from_batches([own])

    bands = kept.select("lang", "term", "lang_n", "groups").mapInArrow(prune, BAND)
    salt = F.pmod(F.xxhash64("term"), F.lit(settings.salts))
    merged = bands.withColumn("salt", salt).groupBy("lang", "source", "salt").applyInArrow(merge, BAND)

    sizes = [
        (lang, s, totals.divisor(lang, s, settings), totals.divisor(lang, None, settings))
        for lang in totals.terms
        for s in totals.sources[lang]
    ]
    divisors = kept.sparkSession.createDataFrame(sizes, "lang string, source string, _p bigint, _q bigint")
    value = _share_column("n", "_p", settings) - _share_column("lang_n", "_q", settings)
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = (
        merged.join(divisors, ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), value.alias("value"))
        .withColumn("rank", F.row_number().over(first))
    )
    return ranked.filter(F.col("rank") <= settings.top)


def _share_column(count: str, divisor: str, settings: Settings) -> Column:
    """:func:`share` as a column."""
    state = F.struct((F.col(count) + settings.smooth).alias("rest"), F.lit(0).cast("long").alias("out"))
    steps, scale = [], settings.scale
    while scale > 1:
        steps.append(min(1000, scale))
        scale //= steps[-1]
    whole = F.aggregate(
        F.array(*[F.lit(s).cast("long") for s in steps]),
        state,
        lambda acc, s: F.struct(
            ((acc["rest"] * s) % F.col(divisor)).alias("rest"),
            (acc["out"] * s + F.call_function("div", acc["rest"] * s, F.col(divisor))).alias("out"),
        ),
    )
    return whole["out"] + 1


def audited(
    docs: DataFrame, settings: Settings = Settings(), lang: str = "lang", source: str = "source", text: str = "text"
) -> DataFrame:
    """``lang source part item value rank``: distances of groups, and terms a group has more of."""
    counts = stored(counted(docs, lang, source, text), "group-terms")
    kept = stored(kept_terms(counts, settings), "kept-terms")
    totals = Totals.of(counts, kept)
    ordered = Window.partitionBy("lang", "a").orderBy(F.desc("value"), F.asc("b"))
    pairs = distances(kept, totals, settings).select(
        "lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value",
        F.row_number().over(ordered).alias("rank"),
    )
    terms = raised(kept, totals, settings).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
