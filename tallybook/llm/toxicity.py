"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is logistic in the words it has; a document's is the
noisy-or of its sentences, ``1 - prod(1 - p)``. Weights are fitted to document
labels only, by gradient steps whose sums are added up over partitions. The
words are those most associated with either label in the training rows.
Sentences of at least the offending probability are then located.

Null and empty texts, and texts without letters, have no sentences and score 0.
Texts are scored whole, row by row; repeated rows score alike. Without training
rows every score is 0. An empty table gives an empty result; columns of the
input are kept unless they are named like an added one.
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

from tallybook.llm.storage import stored
from tallybook.llm.tokens import filled, word_codes

SENTENCE = re.compile(r"[^.!?\n]+")
LETTERS = "a-z\x80-\U0010ffff"
WORD = re.compile(f"[{LETTERS}]+")
LETTER_WORDS = bytes(
    b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
SENTENCES = "[^.!?\n]*[A-Za-z\\x{80}-\\x{10FFFF}][^.!?\n]*"

ADDED = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "offending",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("start", T.IntegerType()),
                        T.StructField("end", T.IntegerType()),
                        T.StructField("p", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)


@dataclass(frozen=True)
class Settings:
    """``max_rows``: bound of the labelled rows that are learned from.
    ``words``: bound of the vocabulary, and so of the model; ``least_rows``: training rows
    a word must be in; ``association``: least log-likelihood ratio of a word."""

    max_rows: int = 20_000
    words: int = 4096
    least_rows: int = 3
    association: float = 13.0
    steps: int = 40
    rate: float = 0.5
    ridge: float = 1e-4
    partitions: int = 12
    offending: float = 0.5


@dataclass
class Model:
    words: dict[str, int]
    weights: np.ndarray
    bias: float


def _words(texts: pa.StringArray):
    return word_codes(pc.utf8_lower(texts), LETTER_WORDS)


def associated(rows: DataFrame, settings: Settings, text: str = "text") -> dict[str, int]:
    """Words by association of document frequency with ``y``: at most ``settings.words``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, per_text, names = _words(filled(batch[text]))
            owner = np.repeat(np.arange(len(per_text)), per_text)
            pairs = np.unique(owner * (len(names) + 1) + codes)
            y = batch["y"].to_numpy(zero_copy_only=False)[pairs // (len(names) + 1)]
            word = pairs % (len(names) + 1)
            ones = np.bincount(word[y == 1], minlength=len(names))
            total = np.bincount(word, minlength=len(names))
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(ones, pa.int64()), pa.array(total, pa.int64())], names=["word", "ones", "rows"]
            )

    found = rows.select("y", text).mapInArrow(count, "word string, ones bigint, rows bigint")
    sums = found.groupBy("word").agg(F.sum("ones").alias("a"), F.sum("rows").alias("n"))
    totals = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("y")).first()
    ones, zeros = float(totals[0]), float(totals[1] - totals[0])
    if not ones or not zeros:
        return {}

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n, share = F.col("n"), ones / (ones + zeros)
    ratio = 2 * (term(F.col("a"), n * share) + term(n - F.col("a"), n * (1 - share)))
    best = (
        sums.filter((n >= settings.least_rows) & (ratio >= settings.association) & (F.col("a") > n * share))
        .orderBy(ratio.desc(), "word")
        .limit(settings.words)
    )
    return {r["word"]: k for k, r in enumerate(best.select("word").collect())}


def sentences(text: str, words: dict[str, int]) -> list[tuple[int, int, list[int]]]:
    """Start, end and known words of every sentence with a letter."""
    out = []
    for m in SENTENCE.finditer(text):
        found = WORD.findall(m[0].lower())
        if found:
            out.append((m.start(), m.end(), [words[w] for w in found if w in words]))
    return out


def bags(texts: pa.StringArray, words: dict[str, int]) -> Iterator[tuple[int, list, int]]:
    """For each text its sentences with known words, and the number of its other sentences.

    Only texts in which a known word occurs are cut into sentences one by one.
    """
    codes, per_text, names = _words(texts)
    known = np.array([w in words for w in names.to_pylist()], bool)
    owner = np.repeat(np.arange(len(per_text)), per_text)
    hit = np.bincount(owner, known[codes] if len(codes) else None, minlength=len(texts)) > 0
    count = pc.count_substring_regex(texts, SENTENCES).to_numpy(zero_copy_only=False)
    for k in range(len(texts)):
        own = [s for s in sentences(texts[k].as_py(), words) if s[2]] if hit[k] else []
        yield k, own, int(count[k]) - len(own)


def fit(rows: DataFrame, settings: Settings = Settings(), text: str = "text") -> Model:
    """Weights from ``rows`` with ``y`` and a text; every step is one pass over their sparse bags."""
    words = associated(rows, settings, text)
    if not words:
        return Model({}, np.zeros(0), -np.inf)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(bags(filled(batch[text]), words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["y"],
                    pa.array([[sorted(set(s[2])) for s in own] for _, own, _ in found], pa.list_(pa.list_(pa.int32()))),
                    pa.array([rest for _, _, rest in found], pa.int64()),
                ],
                names=["y", "bag", "rest"],
            )

    columns = "y int, bag array<array<int>>, rest bigint"
    # Texts are read in the scan's own partitions; only the bounded bags are dealt to a fixed number.
    examples = stored(rows.select("y", text).mapInArrow(sparse, columns).repartition(settings.partitions), "bags")
    weights, moment, square = (np.zeros(len(words) + 1) for _ in range(3))
    weights[:-1], weights[-1] = 1.0, -6.0
    for step in range(1, settings.steps + 1):
        current = weights.copy()

        def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(current), 0
            for batch in batches:
                n += len(batch)
                y = batch["y"].to_numpy(zero_copy_only=False)
                per_row = pc.list_value_length(batch["bag"]).to_numpy(zero_copy_only=False)
                inner = batch["bag"].flatten()
                per_sentence = pc.list_value_length(inner).to_numpy(zero_copy_only=False)
                feature = inner.flatten().to_numpy(zero_copy_only=False)
                sentence = np.repeat(np.arange(len(per_sentence)), per_sentence)
                row = np.repeat(np.arange(len(y)), per_row)
                rest = batch["rest"].to_numpy(zero_copy_only=False)
                z = current[-1] + np.bincount(sentence, current[feature], minlength=len(per_sentence))
                p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-current[-1]))
                clear = np.bincount(row, np.logaddexp(0, z), minlength=len(y)) + rest * np.logaddexp(0, current[-1])
                toxic = -np.expm1(-clear)
                slope = np.where(y == 1, -np.exp(-clear) / np.maximum(toxic, 1e-12), 1.0)
                part = p * slope[row]
                total[:-1] += np.bincount(feature, part[sentence], minlength=len(current) - 1)
                total[-1] += part.sum() + (slope * rest).sum() * p0
            yield pa.RecordBatch.from_arrays(
                [pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], names=["g", "n"]
            )

        # One row per partition, of a fixed number of partitions.
        sums = examples.coalesce(settings.partitions).mapInArrow(gradient, "g array<double>, n bigint").collect()
        g = sum(np.array(r["g"]) for r in sums) / max(1, sum(r["n"] for r in sums))
        g[:-1] += settings.ridge * weights[:-1]
        moment, square = 0.9 * moment + 0.1 * g, 0.99 * square + 0.01 * g * g
        scale = np.sqrt(square / (1 - 0.99**step)) + 1e-8
        weights = weights - settings.rate * moment / (1 - 0.9**step) / scale
    return Model(words, weights[:-1], float(weights[-1]))


def scored(docs: DataFrame, model: Model, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and the ``offending`` sentences (start, end, p; code points)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*ADDED.names)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, *ADDED.fields])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        quiet = np.logaddexp(0, own.bias)
        for batch in batches:
            scores, offending = [], []
            for _, found, rest in bags(filled(batch[text]), own.words):
                z = np.array([own.bias + own.weights[sorted(set(s[2]))].sum() for s in found])
                clear = np.logaddexp(0, z).sum() + rest * quiet
                scores.append(float(-np.expm1(-clear)))
                p = 1 / (1 + np.exp(-z))
                offending.append(
                    [{"start": s[0], "end": s[1], "p": float(q)} for s, q in zip(found, p) if q >= settings.offending]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c] for c in names),
                    pa.array(scores, pa.float64()),
                    pa.array(
                        offending,
                        pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])),
                    ),
                ],
                names=[*names, *ADDED.names],
            )

    return docs.mapInArrow(score, schema)
