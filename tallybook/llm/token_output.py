"""Token ids in binary files of directly addressable codes, in the order of the ids of documents.

Documents are dealt by ranges of ``doc_id`` and encoded with a public tokenizer
file; each task writes segments, one per row of a Parquet table in the shared
folder: the documents, their token counts, and the ids as in
:mod:`tallybook.llm.dac`. Reading back adds one offset per task to the places
inside it. The container is written by Spark's committer, so a retried or lost
task leaves no half-written file.

A null or empty text has the end id only. Null ids of documents come first;
rows with equal ids are ordered by text, and each is a document. An empty table
gives an empty folder and no rows. Other columns are not stored.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.llm import dac
from tallybook.llm.tokens import filled
from tallybook.llm.units import LETTER, Coded, StemStore, encoded_texts, joined

SEGMENT = (
    "part int, seq int, start_in_part bigint, n_tokens bigint,"
    " doc_ids array<bigint>, lengths array<bigint>, codes binary"
)
READ = "doc_id bigint, start bigint, n_tokens bigint, ids binary"

#: A space and letters only. Units are given to the library so many at a time, a text its caches hold.
PLAIN = rf"\A [{LETTER}]+\z"
BLOCK = 300


@lru_cache(maxsize=2)
def _store(path: str, special_as_text: bool) -> StemStore:
    """The tokenizer of a file with the stems and endings this worker has coded by it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text
    opens = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        opens[i] = token.startswith("Ġ")  # how byte-level vocabularies write a space
    unparted = None
    if _keeps_words_apart(tokenizer):
        unparted = Tokenizer.from_file(path)
        unparted.encode_special_tokens = special_as_text
        unparted.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def encode(units: list[str]) -> Coded:
        if unparted is None:
            return joined(units, partial(_ids, tokenizer), opens, BLOCK)
        plain = pc.match_substring_regex(pa.array(units, pa.string()), PLAIN).to_numpy(zero_copy_only=False)
        words, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        one = joined([units[k] for k in words], partial(_ids, unparted), opens, BLOCK, np.ones(len(words), bool))
        two = joined([units[k] for k in others], partial(_ids, tokenizer), opens, BLOCK)
        back = np.empty(len(units), np.int64)
        back[np.concatenate((words, others))] = np.arange(len(units))
        both = Coded(np.concatenate((one.lengths, two.lengths)), np.concatenate((one.ids, two.ids)))
        ids, lengths = both.take(back)
        return Coded(lengths, ids)

    return StemStore(encode, _endings(tokenizer))


def _ids(tokenizer, text: str) -> np.ndarray:
    return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)


def _keeps_words_apart(tokenizer) -> bool:
    """Whether words of ``PLAIN``, end to end, have the ids they have one by one, without being parted first.

    So it is where the file parts them at their spaces only and pairs are merged by rank alone, if no token
    goes on with a space after a letter: then no merge reaches from one word into the next.
    """
    from tokenizers import decoders, models

    model, by = tokenizer.model, tokenizer.pre_tokenizer
    if not (isinstance(model, models.BPE) and by is not None and isinstance(tokenizer.decoder, decoders.ByteLevel)):
        return False
    if model.ignore_merges or model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix:
        return False
    if tokenizer.normalizer is not None:
        return False
    if [p for p, _ in by.pre_tokenize_str(" Ab cdÉ")] != ["ĠAb", "ĠcdÃī"]:
        return False
    inner = [i for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if "Ġ" in token[1:]]
    # Bytes that are a part of a character are decoded to U+FFFD.
    return not any(re.search(r"[^\W_] |\ufffd ", tokenizer.decode([i], skip_special_tokens=False)) for i in inner)


def _endings(tokenizer) -> str:
    """ASCII marks that the pre-tokenizer parts from a letter or number before them.

    Marks of added tokens, which are found before that step, are left out.
    """
    by = tokenizer.pre_tokenizer
    if by is None or tokenizer.normalizer is not None:
        return ""
    added = "".join(token.content for token in tokenizer.get_added_tokens_decoder().values())

    def parted(mark: str) -> bool:
        return all([p for p, _ in by.pre_tokenize_str(c + mark)][1:] == [mark] for c in "a1")

    return "".join(m for m in string.punctuation if m not in added and parted(m))


def segments(
    docs: DataFrame,
    tokenizer_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    special_as_text: bool = True,
) -> DataFrame:
    """Segment rows of all documents, in range partitions by ``doc_id``.

    ``special_as_text`` codes the literal of a special token like other text; without it,
    which is the library's default, the literal is the one id of the token.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = named.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            texts = filled(batch["text"])
            for a, b, ids, counts in encoded_texts(texts, _store(tokenizer_path, special_as_text)):
                ended = np.insert(ids, np.cumsum(counts), end_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int32()),
                        pa.array([seq], pa.int32()),
                        pa.array([start], pa.int64()),
                        pa.array([len(ended)], pa.int64()),
                        pa.array([batch["doc_id"][a:b].to_pylist()], pa.list_(pa.int64())),
                        pa.array([counts + 1], pa.list_(pa.int64())),
                        pa.array([dac.encode(ended)], pa.binary()),
                    ],
                    names=["part", "seq", "start_in_part", "n_tokens", "doc_ids", "lengths", "codes"],
                )
                seq, start = seq + 1, start + len(ended)

    return ordered.mapInArrow(write, SEGMENT)


def write(docs: DataFrame, folder: str, tokenizer_path: str, **names) -> None:
    segments(docs, tokenizer_path, **names).write.option("compression", "zstd").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the files: ``doc_id start n_tokens ids`` (unsigned 32-bit bytes)."""
    files = spark.read.schema(SEGMENT).parquet(folder)
    # One row per task that wrote, so the side that is broadcast is bounded by their number.
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    placed = files.join(F.broadcast(totals.select("part", before.alias("part_start"))), "part")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                starts = np.cumsum(lengths) - lengths
                codes = dac.Codes(row["codes"])
                ids = [codes.between(s, s + n).astype("<u4").tobytes() for s, n in zip(starts.tolist(), row["lengths"])]
                offset = row["part_start"] + row["start_in_part"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(offset + starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    columns = ["part_start", "start_in_part", "doc_ids", "lengths", "codes"]
    return placed.select(*columns).mapInArrow(decode, READ)
