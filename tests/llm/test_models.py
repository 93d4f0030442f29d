"""Trained operators: held-out accuracy, gradients, plain versions of the parts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallybook.llm import catalog, lm_scores, quality_classifier, toxicity
from tallybook.llm.labels import held_out, training_labels


def accuracy(spark, sf_dir, name: str, label: str) -> float:
    got = catalog.queries()[name](spark, sf_dir)
    assert got.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    both = got.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out")
    return both.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]


SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    pytest.importorskip("pandas")
    import os

    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    assert accuracy(spark, SMALL, "op5_quality_classifier", "quality") > 0.95
    assert accuracy(spark, SMALL, "op4_toxicity", "toxic") > 0.88


def test_folds_and_sample(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)] + [(None, 1), (5, None), (6, 0)], "doc_id bigint, y int")
    kept = {r["doc_id"] for r in training_labels(labels, "y", 5, 0).collect()}
    assert kept == {i for i in range(3000) if zlib.crc32(str(i).encode()) % 5}
    some = training_labels(labels, "y", 5, 0, 500)
    assert 350 < some.count() < 650 and {r["doc_id"] for r in some.collect()} <= kept
    assert spark.range(9).select(held_out(5, 0, "id").alias("h")).filter("h IS NULL").count() == 0


def test_toxic_sentences_are_located(spark, odd, nothing):
    clean = "The fox runs home. Birds sing in spring! Rain falls\nand rivers rise."
    rows = [(i, f"{clean} You vile scumbag number {i}. {clean}", 1) for i in range(40)]
    rows += [(100 + i, f"{clean} Number {i} is here. {clean}", 0) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, y int")
    model = toxicity.fit(df, toxicity.Settings(steps=40))
    assert {"vile", "scumbag"} <= set(model.words)
    for r in toxicity.scored(df, model).collect():
        assert (r["score"] >= 0.5) == (r["y"] == 1)
        found = [r["text"][s["start"] : s["end"]] for s in r["offending"]]
        assert all("scumbag" in s for s in found) and len(found) == r["y"]
    got = toxicity.scored(odd, model)
    assert got.count() == odd.count() and got.filter("score IS NULL OR isnan(score)").count() == 0
    assert {r["score"] for r in got.filter("trim(text) = '' OR text IS NULL").collect()} == {0.0}
    assert toxicity.scored(nothing, model).count() == 0
    untrained = toxicity.fit(df.filter("y = 0"))
    assert {r["score"] for r in toxicity.scored(odd, untrained).collect()} == {0.0}


def test_isotonic_curve():
    x = np.arange(6.0)
    at, share = quality_classifier.isotonic(x, np.array([0, 2, 1, 1, 3, 4.0]), np.array([4, 4, 4, 4, 4, 4.0]))
    assert share.tolist() == pytest.approx([0, 4 / 12, 3 / 4, 1]) and at.tolist() == [0, 2, 4, 5]


def test_statistics_of_odd_texts(spark, odd, nothing):
    table = quality_classifier.statistics(pa.array(["", "a b\na b\n", "AA!! | 1"]))
    named = [dict(zip(quality_classifier.STATISTICS, row)) for row in table]
    assert set(named[0].values()) == {0.0}
    assert named[1]["repeated_lines"] == 0.5 and named[1]["distinct_words"] == 0.5 and named[1]["top_word"] == 0.5
    assert named[2]["capitals"] == 2 / 8 and named[2]["bars"] == 1 / 8 and named[2]["digits"] == 1 / 8
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (8, 0)], "doc_id bigint, y int")
    got = quality_classifier.classified(odd, labels)
    assert got.count() == odd.count() and got.filter("score IS NULL OR isnan(score)").count() == 0
    assert quality_classifier.classified(nothing, labels).count() == 0
    assert quality_classifier.classified(odd, labels.limit(0)).filter("score <> 0").count() == 0


def toxic_model(rows: list[tuple[str, int]], words: dict[str, int], settings):
    """The noisy-or fit with a loss written out and its slopes by central differences."""
    bags = []
    for text, y in rows:
        lower = [re.findall("[a-z\x80-\U0010ffff]+", s.lower()) for s in re.split(r"[.!?\n]", text)]
        bags.append(([{words[w] for w in s if w in words} for s in lower if s], y))

    def loss(w):
        total = 0.0
        for bag, y in bags:
            none = 1.0
            for s in bag:
                none *= 1 - 1 / (1 + math.exp(-(w[-1] + sum(w[k] for k in s))))
            total -= math.log(1 - none if y else none)
        return total / len(bags) + settings.ridge / 2 * sum(x * x for x in w[:-1])

    w = [1.0] * len(words) + [-6.0]
    moment, square = [0.0] * len(w), [0.0] * len(w)
    for step in range(1, settings.steps + 1):
        g = [(loss([*w[:k], w[k] + 1e-5, *w[k + 1 :]]) - loss([*w[:k], w[k] - 1e-5, *w[k + 1 :]])) / 2e-5 for k in range(len(w))]
        moment = [0.9 * m + 0.1 * x for m, x in zip(moment, g)]
        square = [0.99 * s + 0.01 * x * x for s, x in zip(square, g)]
        w = [
            x - settings.rate * (m / (1 - 0.9**step)) / (math.sqrt(s / (1 - 0.99**step)) + 1e-8)
            for x, m, s in zip(w, moment, square)
        ]
    return w


def test_noisy_or_against_a_plain_fit(spark):
    rng = np.random.default_rng(3)
    calm, bad = "river stone bird rain spring field home".split(), "vile scum filth rotten".split()
    rows = []
    for i in range(120):
        y = int(i % 3 == 0)
        cut = [[*rng.choice(calm, 3)] for _ in range(4)]
        if y:
            cut[i % 4] += [*rng.choice(bad, 2)]
        elif i % 10 == 1:
            cut[0].append(bad[i % 4])
        rows.append((i, ". ".join(" ".join(s).capitalize() for s in cut) + "!", y))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, y int").repartition(5)
    settings = toxicity.Settings(steps=6, association=4.0)
    # Association: the log-likelihood ratio of a word's rows by label, from a table counted here.
    seen, ones = Counter(), Counter()
    for _, text, y in rows:
        for w in set(re.findall("[a-z]+", text.lower())):
            seen[w] += 1
            ones[w] += y
    share = sum(y for *_, y in rows) / len(rows)
    ratio = {}
    for w, n in seen.items():
        parts = ((ones[w], n * share), (n - ones[w], n * (1 - share)))
        ratio[w] = 2 * sum(a * math.log(a / e) for a, e in parts if a)
    want = [w for w in sorted(ratio, key=lambda w: (-ratio[w], w)) if seen[w] >= 3 and ratio[w] >= 4 and ones[w] > seen[w] * share]
    model = toxicity.fit(df, settings)
    assert sorted(model.words, key=model.words.get) == want and set(bad) <= set(want)
    plain = toxic_model([(t, y) for _, t, y in rows], model.words, settings)
    assert [*model.weights, model.bias] == pytest.approx(plain, rel=1e-4, abs=1e-4)


def test_fourier_ridge_against_plain_numpy(spark):
    rng = np.random.default_rng(11)
    d = len(quality_classifier.STATISTICS)
    stats = rng.normal(size=(400, d)) * rng.uniform(0.5, 3, d)
    stats[:, 3] = 2.0  # a statistic without spread
    y = (np.sin(stats[:, 0]) + stats[:, 1] > 0).astype(int)
    settings = quality_classifier.Settings(features=32)
    rows = [(i, s.tolist(), int(v)) for i, (s, v) in enumerate(zip(stats, y))]
    df = spark.createDataFrame(rows, "doc_id bigint, stats array<double>, y int").repartition(6)
    back = {r[0]: r[1] for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(settings.calibration)) == 0).collect()}
    kept_back = np.array([back[i] for i in range(len(rows))])
    model = quality_classifier.fit(df, settings)
    spread = stats.std(axis=0)
    x = np.clip((stats - stats.mean(axis=0)) / np.where(spread > 1e-9, spread, 1.0), -5, 5)
    z = np.array([[*(math.sqrt(2 / 32) * math.cos(row @ model.directions[:, j] + model.phases[j]) for j in range(32)), 1.0] for row in x])
    a, b = z[~kept_back], y[~kept_back]
    penalty = np.diag([settings.ridge] * 32 + [1e-12]) * len(a)
    weights = np.linalg.lstsq(np.vstack((a, np.sqrt(penalty))), np.concatenate((b, np.zeros(33))), rcond=None)[0]
    assert model.weights == pytest.approx(weights, rel=1e-6, abs=1e-8)
    # Calibration: the non-decreasing curve nearest to the labels, by the min-max formula over bins.
    raw = np.clip(z[kept_back] @ weights, -1, 2)
    bins = np.round((raw + 1) / 3 * settings.bins).astype(int)
    at = np.unique(bins)
    one, n = (np.array([f(y[kept_back][bins == v]) for v in at], float) for f in (np.sum, len))
    level = [
        max(min(one[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(at))) for i in range(k + 1))
        for k in range(len(at))
    ]
    pools = sorted(set(np.round(level, 9)))
    centres = [np.average((at / settings.bins * 3 - 1)[np.round(level, 9) == v], weights=n[np.round(level, 9) == v]) for v in pools]
    assert model.calibrated == pytest.approx(pools) and model.raw == pytest.approx(centres)
    # Cosines of the same draw approach the Gaussian kernel as their number grows.
    wide = quality_classifier.fit(df, quality_classifier.Settings(features=1024))
    f = wide.features(stats[:20])[:, :-1]
    gap = ((x[:20, None] - x[None, :20]) ** 2).sum(axis=2)
    assert np.abs(f @ f.T - np.exp(-gap / (2 * settings.width**2))).max() < 0.15


def plain_mixture(cells: Counter, uniform: float, settings) -> dict[int, list[float]]:
    """Expectation maximisation of the three weights of each bucket, token by token of the table."""
    weights = {}
    for bucket in {k[0] for k in cells}:
        own = [(a, b, m) for (c, a, b), m in cells.items() if c == bucket]
        w = [1 / 3] * 3
        for _ in range(settings.steps):
            took = [0.0] * 3
            for a, b, m in own:
                laws = [10 ** (settings.grid * a) if a <= 0 else 0.0, 10 ** (settings.grid * b) if b <= 0 else 0.0, uniform]
                whole = sum(x * p for x, p in zip(w, laws))
                took = [t + m * x * p / whole for t, x, p in zip(took, w, laws)]
            w = [t / sum(m for *_, m in own) for t in took]
        weights[bucket] = [(1 - settings.floor) * x + settings.floor / 3 for x in w]
    return weights


def language_model(docs: list[tuple[int | None, str | None]], settings):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), " "]) for i, t in docs]
    trained = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in cut]
    words, pairs = Counter(), Counter()
    for (_, w), t in zip(cut, trained):
        if t:
            words.update(w)
            pairs.update(zip([" ", *w], w))
    n, v, cells = sum(words.values()), len(words), Counter()

    def cell(p: float) -> int:
        return round(math.log10(p) / settings.grid) if p > 0 else 1

    def bucket(c: int) -> int:
        return int(math.log2(c)) + 1 if c > 0 else 0

    for (_, w), t in zip(cut, trained):
        for a, b in zip([" ", *w], w) if t else ():
            c = words[a] - 1
            cells[bucket(c), cell((pairs[a, b] - 1) / max(c, 1)), cell((words[b] - 1) / max(1, n - 1))] += 1
    weights = plain_mixture(cells, 1 / (v + 1), settings)
    out = []
    for i, w in cut:
        base = sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for a, b in zip([" ", *w], w):
            k = weights.get(bucket(words[a]), [1 / 3] * 3)
            score += math.log10(k[0] * pairs[a, b] / max(words[a], 1) + k[1] * words[b] / max(1, n) + k[2] / (v + 1))
        out.append((i, len(w), sum(words[x] > 0 for x in w), n, base, score))
    return out


def test_language_model(spark, sf_dir, odd, nothing):
    settings = lm_scores.Settings(shard_words=5000, bucket_entries=1 << 10)
    for df in (spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), odd):
        docs = [(r["doc_id"], r["text"]) for r in df.collect()]
        key = lambda r: (r[0] is not None, r[0] or 0, r[1])
        want = sorted(language_model(docs, settings), key=key)
        got = lm_scores.scored(df, held_out(7, 2), settings)
        got = sorted((tuple(r) for r in got.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=key)
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert [x for g in got for x in g[4:]] == pytest.approx([x for w in want for x in w[4:]], rel=1e-9)
    assert lm_scores.scored(nothing, held_out(7, 2)).count() == 0


def test_requests_of_language_model_in_levels(spark, sf_dir, odd, monkeypatch):
    assert lm_scores.level_bits(1 << 21, lm_scores.Settings()) == []
    assert lm_scores.level_bits(1 << 33, lm_scores.Settings()) == [12]
    assert lm_scores.level_bits(1 << 34, lm_scores.Settings()) == [6, 7]
    tables, keep = {}, lm_scores.stored

    def kept(df, name):
        tables.setdefault(name, []).append(keep(df, name))
        return tables[name][-1]

    monkeypatch.setattr(lm_scores, "stored", kept)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))

    def run(shard_words: int, entries: int, fan_bits: int):
        tables.clear()
        settings = lm_scores.Settings(shard_words=shard_words, bucket_entries=entries, fan_bits=fan_bits)
        rows = sorted(tuple(r) for r in lm_scores.scored(docs.na.fill(-1, ["doc_id"]), held_out(7, 2), settings).collect())
        levels = [t.filter("shard >= 0").count() for t in (*tables["counts"], *tables.get("replies", []))]
        buckets = 2 ** sum(lm_scores.level_bits(sum(r[2] for r in rows), settings))
        shards = tables["shards"][0].count()
        # Two kinds; a merged request stands for a fan-out of askers, and a bucket has one merged request at least.
        assert fan_bits > 9 or all(n <= 2 * max(shards << fan_bits, buckets) for n in levels)
        return rows, levels, shards

    want, once, n = run(1000, 2048, 12)
    assert len(once) == 1
    got, levels, same = run(1000, 2048, 2)
    assert got == want and same == n and len(levels) == 3
    half, finer, more = run(500, 1024, 2)
    assert more > 1.5 * n and [r[:4] for r in half] == [r[:4] for r in want]
    # Other shards add up a text's tokens in another order.
    assert [x for r in half for x in r[4:]] == pytest.approx([x for r in want for x in r[4:]], rel=1e-12)
    assert max(finer) / more <= 1.5 * max(levels) / n
