"""Language-model scores by deleted interpolation of word bigrams, words and a uniform law.

``P(w | v) = a2 c(vw)/c(v) + a1 c(w)/N + a0 / (V + 1)``, with weights by the
frequency bucket of the context v (the power of two below its count). Counts
are over all training documents. The weights maximise, by expectation
maximisation, the probability of every training token under counts from which
that token has been deleted, so each token is held out once.

Documents are cut into shards of tokens that are stored once. A shard asks for
the counts of its distinct words and bigrams, by 64-bit hash; requests are
dealt by the leading bits of the hash, added up there, and answered to each
shard in the order it asked. A shard sends rows to a bounded number of buckets.
Where the corpus needs more, requests of a bucket's askers are first merged,
as many askers as there are buckets, so that a merged request is as large as a
shard's, and is dealt on by the next bits. So a word of a third of the corpus
is one entry per shard, then one per merged request; the rows of each level
are at most shards times fan-out, and what is shuffled grows with the distinct
bigrams of the shards, once more for each level (two levels reach 200 TB).

Tokens are words parted by space and 0x09 to 0x0D, ASCII letters in lower case,
and one end per document, which is also the context of the first word. Null and
empty texts have the end only. Rows are scored one by one, repeated ones alike
(each counts in training). A null id counts as a training document. Without
training rows all scores are those of the uniform law. An empty table gives an
empty result; columns other than id and text are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.storage import stored
from tallybook.llm.tokens import SPACED_WORDS, filled, word_codes

SHARD = (
    "shard bigint, tokens bigint, train_tokens bigint, doc_ids array<bigint>, held array<boolean>,"
    " lengths array<bigint>, vocabulary binary, codes binary"
)
REQUEST = "bucket bigint, shard bigint, n bigint, keys binary, counts binary"
ANSWER = "shard bigint, bucket bigint, n bigint, counts binary"
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
WORDS, BIGRAMS = 0, 1  # buckets are numbered 2 * bucket + kind


@dataclass(frozen=True)
class Settings:
    """``bucket_entries``: about so many requests are added up together.
    ``fan_bits``: a shard or merged request is dealt to at most 2 to this power buckets.
    ``grid``: step of log10 in the table of deleted estimates; ``floor``: least share
    of each of the three laws, times three."""

    shard_words: int = 1_500_000
    bucket_entries: int = 1 << 21
    fan_bits: int = 12
    grid: float = 0.1
    steps: int = 60
    floor: float = 1e-6


def _packed(values: np.ndarray) -> bytes:
    """Bytes of like weight together, compressed."""
    rows = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return pa.compress(np.ascontiguousarray(rows.T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of 64-bit hashes."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: pa.StringArray) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()], np.uint64)


def shards(docs: DataFrame, held: Column, settings: Settings, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenized shards. Codes point into a shard's vocabulary, which is sorted by hash."""
    named = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text).alias("text")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        end = _hashes(pa.array([" "]))
        for batch in batches:
            codes, per_text, names = word_codes(filled(batch["text"]), SPACED_WORDS)
            hashes = np.concatenate((_hashes(names), end))
            ends = np.cumsum(per_text)
            bounds = np.flatnonzero(np.diff(ends // settings.shard_words)) + 1
            cuts = [0, *bounds, len(per_text)] if len(per_text) else []
            for a, b in zip(cuts, cuts[1:]):
                start = ends[a] - per_text[a]
                tokens = np.insert(codes[start : ends[b - 1]], ends[a:b] - start, len(names))
                used, inverse = np.unique(tokens, return_inverse=True)
                order = np.argsort(hashes[used])
                rank = np.empty(len(used), np.int32)
                rank[order] = np.arange(len(used))
                lengths = per_text[a:b] + 1
                held_out = batch["held"][a:b].to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(part << 24) + seq], pa.int64()),
                        pa.array([len(tokens)], pa.int64()),
                        pa.array([int(lengths[~held_out].sum())], pa.int64()),
                        pa.array([batch["doc_id"][a:b].to_pylist()], pa.list_(pa.int64())),
                        pa.array([held_out], pa.list_(pa.bool_())),
                        pa.array([lengths], pa.list_(pa.int64())),
                        pa.array([hashes[used][order].tobytes()], pa.binary()),
                        pa.array([_packed(rank[inverse])], pa.binary()),
                    ],
                    names=["shard", "tokens", "train_tokens", "doc_ids", "held", "lengths", "vocabulary", "codes"],
                )
                seq += 1

    return named.mapInArrow(cut, SHARD)


class Shard:
    """One shard's tokens, its distinct words and bigrams, and the order they are asked for."""

    def __init__(self, row: dict) -> None:
        self.ids = row["doc_ids"]
        self.held = np.array(row["held"], bool)
        self.lengths = np.array(row["lengths"], np.int64)
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        self.codes = _unpacked(row["codes"], row["tokens"], np.int32).astype(np.int64)
        self.trained = np.repeat(~self.held, self.lengths)
        last = np.cumsum(self.lengths) - 1
        end = self.codes[last[0]]
        self.before = np.concatenate(([end], self.codes[:-1]))
        size = len(self.vocabulary)
        pairs, self.pair = np.unique(self.before * size + self.codes, return_inverse=True)
        keys = _mixed(self.vocabulary[pairs // size], self.vocabulary[pairs % size])
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair = place[self.pair]

    def requests(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for kind, keys, at in ((WORDS, self.vocabulary, self.codes), (BIGRAMS, self.pair_keys, self.pair)):
            yield kind, keys, np.bincount(at[self.trained], minlength=len(keys)).astype(np.uint64)


def level_bits(entries: int, settings: Settings) -> list[int]:
    """Bits of the hash that each level deals by, as even as can be; none where one bucket holds all."""
    bits = max(0, int(np.ceil(np.log2(max(1, entries / settings.bucket_entries)))))
    levels = -(-bits // settings.fan_bits)
    return [bits * (i + 1) // levels - bits * i // levels for i in range(levels)]


def _dealt(asker: int, kind: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows of one asker, a row for each leading ``bits`` that its sorted keys have."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = [*starts[1:], len(keys)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(2 * bucket[starts] + kind, pa.int64()),
            pa.array(np.full(len(starts), asker), pa.int64()),
            pa.array(ends - starts, pa.int64()),
            pa.array([_packed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in zip(starts, ends)], pa.binary()),
            pa.array([_packed(counts[a:b]) for a, b in zip(starts, ends)], pa.binary()),
        ],
        names=["bucket", "shard", "n", "keys", "counts"],
    )


def requests(stored_shards: DataFrame, bits: int) -> DataFrame:
    """Keys and training counts of every shard by the leading ``bits`` of the keys."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for kind, keys, counts in Shard(row).requests():
                    yield _dealt(row["shard"], kind, keys, counts, bits)

    return stored_shards.mapInArrow(ask, REQUEST)


def _added(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of some requests, in order, their summed counts, and the place of every asked key."""
    keys = np.concatenate([np.cumsum(_unpacked(r["keys"], r["n"], np.uint64), dtype=np.uint64) for r in rows])
    counts = np.concatenate([_unpacked(r["counts"], r["n"], np.uint64) for r in rows])
    distinct, inverse = np.unique(keys, return_inverse=True)
    # Counts are far below 2**53, so sums of doubles are exact.
    totals = np.bincount(inverse, counts.astype(np.float64), minlength=len(distinct)).astype(np.uint64)
    return distinct, totals, inverse


def _replied(rows: list[dict], found: np.ndarray) -> list[tuple]:
    """Answers to some requests from the counts of all their keys."""
    ends = np.cumsum([r["n"] for r in rows])
    return [(r["shard"], r["bucket"], r["n"], _packed(found[e - r["n"] : e])) for r, e in zip(rows, ends)]


def _answer_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.Table.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=["shard", "bucket", "n", "counts"]
    )


def answers(asked: DataFrame, askers: int, bits: list[int], level: int = 0) -> DataFrame:
    """Corpus counts for each request; and, as shard -1, the distinct trained keys of a bucket.

    ``asked`` are requests of ``askers`` shards, or merged requests a bucket, by
    the first ``level + 1`` entries of ``bits``.
    """
    if level + 1 >= len(bits):

        def add_up(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            _, totals, inverse = _added(rows)
            distinct = (-1, rows[0]["bucket"], int((totals > 0).sum()), None)
            return _answer_table([*_replied(rows, totals[inverse]), distinct])

        return asked.groupBy("bucket").applyInArrow(add_up, ANSWER)

    groups = max(1, askers >> bits[level])
    depth = sum(bits[: level + 2])
    own = stored(asked, "requests").withColumn(
        "merged", F.col("bucket") * groups + F.pmod(F.xxhash64("shard"), F.lit(groups))
    )

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys, totals, _ = _added(rows)
        return pa.Table.from_batches([_dealt(rows[0]["merged"], rows[0]["bucket"] % 2, keys, totals, depth)])

    replies = stored(answers(own.groupBy("merged").applyInArrow(merge, REQUEST), groups, bits, level + 1), "replies")

    def hand_back(request_rows: pa.Table, reply_rows: pa.Table) -> pa.Table:
        rows = request_rows.to_pylist()
        parts = sorted(reply_rows.to_pylist(), key=lambda r: r["bucket"])
        found = np.concatenate([_unpacked(r["counts"], r["n"], np.uint64) for r in parts])
        return _answer_table(_replied(rows, found[_added(rows)[2]]))

    back = own.groupBy("merged").cogroup(replies.filter("shard >= 0").groupBy("shard")).applyInArrow(hand_back, ANSWER)
    return back.unionByName(replies.filter("shard < 0"))


def _joined(shard_rows: pa.Table, answer_rows: pa.Table) -> tuple[Shard, np.ndarray, np.ndarray]:
    """A shard with the corpus counts of its words and bigrams."""
    shard = Shard(shard_rows.to_pylist()[0])
    found = {}
    replies = sorted(answer_rows.to_pylist(), key=lambda r: r["bucket"])
    for kind in (WORDS, BIGRAMS):
        found[kind] = np.concatenate(
            [_unpacked(r["counts"], r["n"], np.uint64) for r in replies if r["bucket"] % 2 == kind]
        ).astype(np.float64)
    return shard, found[WORDS], found[BIGRAMS]


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 plus the power of two below the count."""
    return np.where(counts > 0, np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, 0)


def _log_cell(p: np.ndarray, grid: float) -> np.ndarray:
    """Grid cell of log10 p; the cell of 0 is 1, above all others."""
    return np.where(p > 0, np.round(np.log10(np.maximum(p, 1e-300)) / grid), 1).astype(np.int64)


def deleted_cells(pairs, total: int, settings: Settings) -> DataFrame:
    """``context a b n``: training tokens by context bucket and by grid cells of their deleted estimates."""

    def tally(shard_rows: pa.Table, answer_rows: pa.Table) -> pa.Table:
        shard, words, bigrams = _joined(shard_rows, answer_rows)
        here = shard.trained
        context = words[shard.before[here]] - 1
        of_pair = (bigrams[shard.pair[here]] - 1) / np.maximum(context, 1)
        of_word = (words[shard.codes[here]] - 1) / max(1, total - 1)
        cells = np.stack(
            (context_bucket(context), _log_cell(of_pair, settings.grid), _log_cell(of_word, settings.grid))
        )
        distinct, n = np.unique(cells, axis=1, return_counts=True)
        return pa.Table.from_arrays([*map(pa.array, distinct), pa.array(n)], names=["context", "a", "b", "n"])

    cells = pairs.applyInArrow(tally, "context bigint, a bigint, b bigint, n bigint")
    return cells.groupBy("context", "a", "b").agg(F.sum("n").alias("n"))


def mixture(cells: list[tuple[int, int, int, int]], uniform: float, settings: Settings) -> np.ndarray:
    """Weights of the three laws by context bucket, learned from the table of deleted estimates."""
    table = np.array(cells, np.int64).reshape(-1, 4)
    weights = np.full((66, 3), 1 / 3)
    for bucket in np.unique(table[:, 0]):
        own = table[table[:, 0] == bucket]
        laws = [np.where(own[:, k] > 0, 0.0, 10.0 ** (settings.grid * own[:, k])) for k in (1, 2)]
        p = np.stack([*laws, np.full(len(own), uniform)], axis=1)
        for _ in range(settings.steps):
            share = p * weights[bucket]
            share /= share.sum(axis=1, keepdims=True)
            weights[bucket] = own[:, 3] @ share / own[:, 3].sum()
    return (1 - settings.floor) * weights + settings.floor / 3


def scored(docs: DataFrame, held: Column, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id held_out n_tokens n_known train_tokens base_score score`` of all documents."""
    own = stored(shards(docs, held, settings, doc_id, text), "shards")
    tokens, total, n = own.agg(
        F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("train_tokens"), F.lit(0)), F.count("*")
    ).first()
    bits = level_bits(tokens, settings)
    replies = stored(answers(requests(own, bits[0] if bits else 0), n, bits), "counts")
    distinct = replies.filter((F.col("shard") == -1) & (F.col("bucket") % 2 == WORDS))
    types = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = own.groupBy("shard").cogroup(replies.filter("shard >= 0").groupBy("shard"))
    # The table has a fixed number of possible cells, whatever the corpus.
    cells = [tuple(r) for r in deleted_cells(pairs, total, settings).collect()]
    weights = mixture(cells, 1 / (types + 1), settings)

    def score(shard_rows: pa.Table, answer_rows: pa.Table) -> pa.Table:
        shard, words, bigrams = _joined(shard_rows, answer_rows)
        count, context = words[shard.codes], words[shard.before]
        mix = weights[context_bucket(context)]
        p = (
            mix[:, 0] * bigrams[shard.pair] / np.maximum(context, 1)
            + mix[:, 1] * count / max(1, total)
            + mix[:, 2] / (types + 1)
        )
        starts = np.cumsum(shard.lengths) - shard.lengths
        return pa.Table.from_arrays(
            [
                pa.array(shard.ids, pa.int64()),
                pa.array(shard.held),
                pa.array(shard.lengths),
                pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)),
                pa.array(np.add.reduceat(np.log10((count + 1) / (total + types + 1)), starts)),
                pa.array(np.add.reduceat(np.log10(p), starts)),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    return pairs.applyInArrow(score, SCORED).withColumn("train_tokens", F.lit(total).cast("long"))
