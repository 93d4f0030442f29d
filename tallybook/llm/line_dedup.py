r"""Lines that many documents share, kept in one of them.

A line's key is the line without the white space at its ends, ASCII letters in
lower case. Long keys that at least ``documents`` documents hold lose all their
lines, except in the document of the largest id that holds them.

Hashes of the long keys fill two Bloom filters (:mod:`tallybook.llm.twice_seen`),
sized by their number, ``most_bits`` at most. Only keys that the second filter
takes for repeated leave their tasks. They are counted exactly, by their text,
and the documents that lose a line are found by a join on the key; a third
filter tells which rows can be among those, so that other texts aren't
shuffled. A false positive costs work, never a line. Beyond ``most_bits`` the
filters fill up, more keys are counted exactly, and the result stays the same.

A null or empty text is one empty line. Rows of one id are one document, and
lose the same keys. Rows without an id come before all ids; those of equal text
are one document. An empty table gives an empty result. Other columns are kept,
unless they are named like an added one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm.storage import stored
from tallybook.llm.tokens import filled
from tallybook.llm.twice_seen import filter_bits, may_hold, seen

BLANKS = " \t\n\x0b\x0c\r"
ADDED = T.StructType(
    [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())]
)


@dataclass(frozen=True)
class Settings:
    """``most_bits``: of one filter, an eighth of that in bytes on the driver and in each worker."""

    min_chars: int = 40
    documents: int = 5
    bits_per_key: int = 8
    most_bits: int = 1 << 30


def _keys(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Keys of all lines, and lines per text."""
    lists = pc.split_pattern(texts, "\n")
    per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.ascii_lower(pc.utf8_trim(lists.flatten(), characters=BLANKS)), per_text


def _long_keys(texts: pa.StringArray, min_chars: int) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Distinct long keys of each text, end to end; the texts they are of; their hashes."""
    import xxhash

    keys, per_text = _keys(texts)
    long = pc.greater_equal(pc.utf8_length(keys), min_chars)
    owner = np.repeat(np.arange(len(texts)), per_text)[long.to_numpy(zero_copy_only=False)]
    keys = keys.filter(long)
    hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys.to_pylist()], np.uint64)
    # Equal keys of a text meet in this order; unequal ones of one hash are both kept.
    coded = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.unique(owner * max(1, len(keys)) + coded, return_index=True)[1]
    return keys.take(pa.array(first)), owner[first], hashes[first]


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``named id``: the identity of a row's document. Rows without an id go by a hash of their text."""
    name = F.col(doc_id).cast("long")
    return docs.withColumns(
        {"_named": name.isNotNull(), "_id": F.coalesce(name, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))}
    )


def key_hashes(docs: DataFrame, text: str, settings: Settings) -> DataFrame:
    """``hashes`` of each row's distinct long keys."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, owner, hashes = _long_keys(filled(batch["text"]), settings.min_chars)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(batch)))))
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.view(np.int64)))], names=["hashes"]
            )

    return docs.select(F.col(text).alias("text")).mapInArrow(cut, "hashes array<bigint>")


def suspects(named: DataFrame, text: str, twice, settings: Settings) -> DataFrame:
    """``named id key`` of the long keys that the second filter takes for repeated."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owner, hashes = _long_keys(filled(batch["text"]), settings.min_chars)
            some = may_hold(twice.value, hashes)
            rows = pa.array(owner[some])
            yield pa.RecordBatch.from_arrays(
                [batch["named"].take(rows), batch["id"].take(rows), keys.filter(pa.array(some))], names=["named", "id", "key"]
            )

    columns = [F.col("_named").alias("named"), F.col("_id").alias("id"), F.col(text).alias("text")]
    return named.select(*columns).mapInArrow(find, "named boolean, id bigint, key string")


def losses(found: DataFrame, settings: Settings) -> DataFrame:
    """``_named _id keys``: what each document loses. Counted per key and document first, so a
    key of a third of all documents is added up before it meets one task."""
    last = F.max(F.struct("named", "id"))
    per_key = found.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("held"), last.alias("last"))
    # Stored, so that the join meets two plain tables and can split a key of many documents.
    shared = stored(per_key.filter(F.col("held") >= settings.documents).select("key", "last"), "shared-lines")
    lost = found.join(shared, "key").filter(F.struct("named", "id") != F.col("last"))
    return lost.groupBy(F.col("named").alias("_named"), F.col("id").alias("_id")).agg(F.collect_set("key").alias("keys"))


def _without(docs: DataFrame, text: str) -> DataFrame:
    """Rows of ``docs`` (with ``keys``) without the lines of those keys."""
    names = [c for c in docs.columns if c != "keys"]
    schema = T.StructType([*(docs.schema[c] for c in names), *ADDED.fields])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch[text])
            keys, per_text = _keys(texts)
            counts, kept, at = [], [], 0
            for t, n, gone in zip(texts, per_text.tolist(), batch["keys"]):
                lines, own = t.as_py(), None
                gone = set(gone.as_py() or ())
                if gone:
                    own = [k not in gone for k in keys.slice(at, n).to_pylist()]
                    lines = "\n".join([line for line, stays in zip(lines.split("\n"), own) if stays])
                counts.append(n - sum(own) if own else 0)
                kept.append(lines)
                at += n
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in names), pa.array(per_text), pa.array(counts, pa.int64()), pa.array(kept, pa.string())],
                names=[*names, *ADDED.names],
            )

    return docs.mapInArrow(drop, schema)


def deduplicated(
    docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and the text that is ``kept``."""
    spark = docs.sparkSession
    docs = docs.select(*[c for c in docs.columns if c not in ADDED.names and c not in ("_named", "_id", "keys")])
    hashes = stored(key_hashes(docs, text, settings), "line-hashes")
    count = hashes.agg(F.coalesce(F.sum(F.size("hashes").cast("long")), F.lit(0))).first()[0]
    bits = filter_bits(count, settings.bits_per_key, settings.most_bits)
    twice = spark.sparkContext.broadcast(seen(hashes, bits))

    named = _named(docs, doc_id, text)
    found = stored(suspects(named, text, twice, settings), "suspects")
    lost = stored(losses(found, settings), "losses")

    # Rows whose document can't lose a line stay where they are.
    own = F.xxhash64("_named", "_id")
    bits = filter_bits(lost.count(), settings.bits_per_key, settings.most_bits)
    losing = spark.sparkContext.broadcast(seen(lost.select(F.array(own).alias("h")), bits, twice=False))

    @F.pandas_udf("boolean")
    def may_lose(h: pd.Series) -> pd.Series:
        return pd.Series(may_hold(losing.value, h.to_numpy(np.int64).view(np.uint64)))

    marked = named.withColumn("_may", may_lose(own))
    some = marked.filter("_may").drop("_may").join(lost, ["_named", "_id"], "left")
    whole = F.coalesce(F.col(text), F.lit(""))
    others = marked.filter("NOT _may").drop("_may").withColumns(
        {
            "n_lines": (F.length(whole) - F.length(F.translate(whole, "\n", "")) + 1).cast("long"),
            "n_dropped": F.lit(0).cast("long"),
            "kept": whole,
        }
    )
    return others.unionByName(_without(some, text)).drop("_named", "_id")
