"""The FM-index and the removal spans against plain search."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from compare import connect, difference

from tallybook.llm import catalog, decontaminate
from tallybook.llm.fm_index import FMIndex, WaveletTree, suffix_order

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for item, phrase in items:
        w = words(phrase)
        size = min(10, len(w))
        windows = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
        for k in range(len(own) - size + 1):
            if tuple(own[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                found.add(item)
    return len(own), hit, sorted(found)


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_every_occurrence(seed):
    draw = np.random.default_rng(seed)
    text = np.concatenate([np.append(draw.integers(1, 4, draw.integers(0, 40)), 0) for _ in range(12)] * 2)
    keys = [[(s, p) if s == 0 else (s, 0) for p, s in enumerate(text[i:], i)] for i in range(len(text))]
    cut = [k[: next(j for j, x in enumerate(k) if x[0] == 0) + 1] for k in keys]
    assert suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: cut[i])
    index = FMIndex(text, sample=5)
    for size in (1, 2, 4):
        phrases = np.unique(draw.integers(1, 5, (30, size)), axis=0)
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(len(text) - size + 1) if (text[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


def test_wavelet_ranks():
    symbols = np.random.default_rng(1).integers(0, 37, 500)
    tree = WaveletTree(symbols)
    at = np.arange(501)
    for s in (0, 5, 36):
        assert tree.rank(np.full(501, s), at).tolist() == [int((symbols[:i] == s).sum()) for i in at]
    assert (tree.access(np.arange(500)) == symbols).all()


def test_query_equals_sql(spark, sf_dir):
    name = "op1_benchmark_decontamination"
    mine = catalog.queries()[name](spark, sf_dir).toPandas()
    assert difference(mine, connect(sf_dir).sql(catalog.oracle_sql()[name]).df()) is None


def test_spans_and_removal(spark, odd, nothing):
    draw = random.Random(5)
    vocabulary = [f"w{k}" for k in range(8)]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.choice([1, 4, 12, 30])))) for k in range(5)]
    items += [(5, None), (6, "..."), (None, "w1 w2"), (0, items[0][1])]
    texts = [" ".join(draw.choices(vocabulary + ["other", "Ünder"], k=300)) for _ in range(6)]
    texts += [f"Before! {items[3][1].upper()}, after.", None, "", "w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    known = [i for i in items if i[0] is not None]
    for block in (1 << 25, 40):  # one pass, and several
        found = decontaminate.contaminated(docs, bench, settings=decontaminate.Settings(block_bytes=block, sample=3))
        for r in found.collect():
            n, hit, names = brute(texts[r["doc_id"]], known)
            covered = {k for s in r["word_spans"] for k in range(s["first"], s["last"])}
            assert (r["n_words"], covered, r["items"]) == (n, hit, names)
        clean = {r["doc_id"]: r["text"] for r in decontaminate.removed(found).collect()}
        for k, t in enumerate(texts):
            hit = brute(t, known)[1]
            assert words(clean[k]) == [w for j, w in enumerate(words(t)) if j not in hit]
    assert clean[6] == "Before! , after." or brute(texts[6], known)[1] != set(range(1, 1 + len(words(items[3][1]))))
    assert decontaminate.contaminated(odd, bench).count() == odd.count()
    assert decontaminate.contaminated(nothing, bench).count() == 0
    empty = bench.limit(0)
    assert decontaminate.contaminated(odd, empty).filter("size(word_spans) > 0").count() == 0
