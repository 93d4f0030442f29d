"""The stages in a row against brute-force versions of each."""

from __future__ import annotations

import importlib
import math
import re
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

from test_decontaminate import brute as contaminated  # noqa: E402
from test_jaccard_join import brute as linked  # noqa: E402
from test_quality_rules import buckets, counts  # noqa: E402
from test_secrets import ASSIGN  # noqa: E402

from tallybook.llm import decontaminate, quality_rules, unigram  # noqa: E402
from tallybook.llm.vocabulary import tokenizer_path  # noqa: E402

pipeline = importlib.import_module("corpus_pipeline")


def good(docs: dict[int, str]) -> dict[int, str]:
    rules = quality_rules.Rules()
    grams = {i: buckets(t, rules) for i, t in docs.items()}
    raw, target = Counter(), Counter()
    for i, t in docs.items():
        raw.update(grams[i])
        long_enough = len(re.split(r"[\x20\x09-\x0D]+", t)) >= rules.trusted_words
        shouts = any(len(r) >= 4 for r in "".join(c if c.isupper() else " " for c in t).split())
        if long_enough and not shouts and not re.search(quality_rules.SYMBOL, t):
            target.update(grams[i])
    n, m, size = raw.total(), target.total(), rules.buckets

    def ratio(b: int) -> float:
        share = (raw[b] + 1) / (n + size)
        return math.log((target[b] + size * share) / (m + size) / share)

    kept = {}
    for i, t in docs.items():
        c = counts(t)
        mean = sum(map(ratio, grams[i])) / max(1, len(grams[i]))
        if c[0] >= 20 and 100 * c[4] <= 30 * c[0] and mean >= rules.threshold:
            kept[i] = t
    return kept


def hidden(text: str) -> str:
    spans = [m.span() for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", text)]
    covered = decontaminate.merged(spans)
    for a, b in reversed(covered):
        text = text[:a] + "[secret]" + text[b:]
    return text


def test_stages(spark, sf_dir):
    assert [name for name, _ in pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans",
        "SentencePiece encoding and decoding",
    ]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = good(docs)
    kept = {i: kept[i] for i, (_, first) in linked(list(kept.items())).items() if i == first}
    for i, t in kept.items():
        hit = sorted(contaminated(t, items)[1])
        kept[i] = hidden(decontaminate.without_spans(t, decontaminate.merged([(h, h + 1) for h in hit])))
    model = unigram.Model.load(tokenizer_path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(kept)
    for i, t in kept.items():
        assert model.decode(got[i]["ids"]) == t and got[i]["n_chars"] == len(t) and got[i]["same_text"]


def test_odd_rows(spark, odd, nothing, sf_dir):
    for frame in (odd, nothing):
        docs = frame.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "0L AS n_chars", "1 AS kept")
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == pipeline.COLUMNS
            assert out.count() <= docs.count()
        assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_near_copies_are_by_the_stage_s_own_rule(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    texts = [words, [*words[:59], "x"], [*words[:30], "x", *words[31:]]]  # 56 / 58 and 53 / 61 4-grams shared
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    linked = pipeline.jaccard_join.linked
    asked = []
    monkeypatch.setattr(pipeline.jaccard_join, "linked", lambda d, *settings: asked.extend(settings) or linked(d, *settings))
    assert {r["doc_id"] for r in pipeline.keep_one_of_each(spark, docs, "").collect()} == {0}
    assert [(s.words, s.percent) for s in asked] == [(4, 85)]


def test_texts_that_share_an_id_are_judged_apart(spark):
    texts = [" ".join(f"{a}{k}" for k in range(30)) for a in "xyz"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[0]), (3, texts[1] + " end"), (0, texts[2]), (None, texts[2])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [(r["doc_id"], r["text"]) for r in pipeline.keep_one_of_each(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, texts[0]), (1, texts[1]), (0, texts[2]), (None, texts[2])], key=str)
