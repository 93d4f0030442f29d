"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Every document gets a fixed list of statistics. Standardised, they go through
random cosines whose inner products approximate a Gaussian kernel. The normal
equations of the ridge fit are sums over rows, added up by a fixed number of
partitions; part of the training rows is kept back to calibrate the scores by
the isotonic curve that pools adjacent violators.

A null or empty text has the statistics of no words and is scored like any
other. Texts are used whole, row by row; repeated rows score alike. Without
training rows of both labels the score is their share of ones, or 0. An empty
table gives an empty result. Columns other than the id are dropped from the
stored statistics, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.storage import stored
from tallybook.llm.sums import summed
from tallybook.llm.tokens import SPACED_WORDS, filled, word_codes

STATISTICS = [
    "log_words", "word_bytes", "symbols", "capitals", "exclamations", "bars", "digits", "line_ends",
    "repeated_lines", "distinct_words", "top_word", "equal_neighbours", "full_stops", "line_bytes",
    "short_words",
]
CLASSES = {
    "symbols": b"#*$%&|<>",
    "capitals": bytes(range(65, 91)),
    "exclamations": b"!",
    "bars": b"|",
    "digits": b"0123456789",
    "full_stops": b".",
}


@dataclass(frozen=True)
class Settings:
    features: int = 256
    width: float = 3.0
    ridge: float = 1e-3
    calibration: int = 4  # one of so many training rows is kept back for the calibration
    bins: int = 2000  # of raw scores between -1 and 2
    seed: int = 7


def statistics(texts: pa.StringArray) -> np.ndarray:
    """One row of :data:`STATISTICS` per text."""
    n = len(texts)
    codes, words, names = word_codes(texts, SPACED_WORDS)
    out = {name: np.zeros(n) for name in STATISTICS}
    sizes = np.zeros(n)
    for k, text in enumerate(texts.to_pylist()):
        raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        sizes[k] = size = raw.sum()
        for name, members in CLASSES.items():
            out[name][k] = raw[list(members)].sum() / max(1, size)
        out["line_ends"][k] = raw[10] / max(1, size)
        lines = [line for line in text.split("\n") if line]
        out["repeated_lines"][k] = (len(lines) - len(set(lines))) / max(1, len(lines))
        out["line_bytes"][k] = np.log1p(size / max(1, len(lines)))
    some = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), words)
    out["log_words"] = np.log1p(words)
    lengths = np.array([len(w) for w in names.to_pylist()], np.int64)[codes] if len(codes) else codes
    out["word_bytes"] = np.log1p(np.bincount(owner, lengths, minlength=n) / some)
    out["short_words"] = np.bincount(owner, lengths <= 3, minlength=n) / some
    pairs, counts = np.unique(owner * (len(names) + 1) + codes, return_counts=True)
    by_text = pairs // (len(names) + 1)
    out["distinct_words"] = np.bincount(by_text, minlength=n) / some
    top = np.zeros(n)
    np.maximum.at(top, by_text, counts)
    out["top_word"] = top / some
    same = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    out["equal_neighbours"] = np.bincount(owner[1:][same], minlength=n) / some
    return np.stack([out[name] for name in STATISTICS], axis=1)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, stats`` of all rows; a few numbers a row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                rows = statistics(filled(batch["text"]))
                offsets = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], lists], names=["doc_id", "stats"])

    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return named.mapInArrow(measure, "doc_id bigint, stats array<double>")


@dataclass
class Model:
    """Moments of the statistics, cosines, ridge weights, and the calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    calibrated: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        waves = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack((waves, np.ones((len(waves), 1))))

    def raw_scores(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.features(stats) @ self.weights, -1, 2)

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw_scores(stats), self.raw, self.calibrated)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, len(STATISTICS))


def isotonic(x: np.ndarray, ones: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Curve of non-decreasing shares over ascending ``x``: centres and shares of the pooled blocks."""
    blocks: list[list[float]] = []
    for at, a, n in zip(x, ones, rows):
        blocks.append([at * n, a, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    table = np.array(blocks)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """From rows of ``doc_id, stats, y``; the driver gets one matrix, added up over partitions in a tree."""
    d, width = len(STATISTICS), settings.features
    moments = (
        labelled.select(F.posexplode("stats").alias("k", "v"))
        .groupBy("k")
        .agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        .collect()
    )
    mean, scale = np.zeros(d), np.ones(d)
    for r in moments:
        mean[r["k"]], scale[r["k"]] = r["m"], r["s"] if r["s"] > 1e-9 else 1.0
    drawn = np.random.default_rng(settings.seed)
    model = Model(
        mean,
        scale,
        drawn.normal(size=(d, width)) / settings.width,
        drawn.uniform(0, 2 * np.pi, width),
        np.zeros(width + 1),
        np.array([-1.0, 2.0]),
        np.zeros(2),
    )
    kept_back = F.pmod(F.xxhash64("doc_id"), F.lit(settings.calibration)) == 0

    def normal(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((width + 1, width + 2))
        for batch in batches:
            z = model.features(_matrix(batch["stats"]))
            y = batch["y"].to_numpy(zero_copy_only=False)
            total += z.T @ np.column_stack((z, y))
        return total

    both = summed(labelled.filter(~kept_back).select("stats", "y"), normal, (width + 1, width + 2))
    n = max(1.0, both[-1, width])
    penalty = settings.ridge * np.eye(width + 1)
    penalty[-1, -1] = 1e-12
    model.weights = np.linalg.solve(both[:, :-1] / n + penalty, both[:, -1] / n)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.raw_scores(_matrix(batch["stats"]))
            bins = np.round((values + 1) / 3 * settings.bins).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch["y"]], names=["bin", "y"])

    counts = (
        labelled.filter(kept_back)
        .select("stats", "y")
        .mapInArrow(raw, "bin int, y int")
        .groupBy("bin")
        .agg(F.sum("y").alias("a"), F.count("y").alias("n"))
        .collect()
    )
    if counts:
        table = np.array(sorted((r["bin"], r["a"], r["n"]) for r in counts), float)
        model.raw, model.calibrated = isotonic(table[:, 0] / settings.bins * 3 - 1, table[:, 1], table[:, 2])
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of rows of :func:`measured`."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.scores(_matrix(batch["stats"]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(values)], names=["doc_id", "score"])

    return stats.mapInArrow(score, "doc_id bigint, score double")


def classified(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """``doc_id, score`` of all documents, learned from ``labels`` (``doc_id, y``)."""
    stats = stored(measured(docs, text=text), "statistics")
    return scored(stats, fit(stats.join(labels, "doc_id"), settings))
