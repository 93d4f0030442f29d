"""Quality rules against a brute-force version."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

xxhash = pytest.importorskip("xxhash")

from tallybook.llm import quality_rules as q  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


COUNTS = q.COUNTS


def test_base_counts(spark, sf_dir, odd):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["a b c d e f g h " * 2, "a b c d e f g h i a b c d e f g h", "x y\x0bz", "l\nl\n l\n\nl"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for r in q.base_counts(df).collect():
        assert tuple(r[c] for c in COUNTS) == counts(texts[r["doc_id"]])
    for r in q.base_counts(odd).select("text", *COUNTS).collect():
        assert tuple(r[c] for c in COUNTS) == counts(r["text"])


def buckets(text: str, rules: q.Rules) -> list[int]:
    pieces = re.findall(r"\w+|[^\w\s]+", text.lower())

    def bucket(value: int) -> int:
        return (value if value < 2**63 else value - 2**64) % rules.buckets

    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in pieces]

    def pair(a: int, b: int) -> int:
        first = xxhash.xxh64_intdigest(a.to_bytes(8, "little"), seed=42)
        return xxhash.xxh64_intdigest(b.to_bytes(8, "little"), seed=first)

    return [bucket(h) for h in hashes] + [bucket(pair(a, b)) for a, b in zip(hashes, hashes[1:])]


def test_ratio_against_brute_force(spark):
    good = "the quick brown fox jumps over the lazy dog again and again while it rains. " * 5
    bad = "### win $$$ *** click %%% here &&& now ||| " * 12
    texts = [good, bad, good + "tail", "short", "", None]
    rules = q.Rules(buckets=64, smoothing=0.5)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    raw, target = Counter(), Counter()
    for t in texts:
        own = buckets(t or "", rules)
        raw.update(own)
        if t and len(t.split()) >= 50 and not re.search(q.SYMBOL, t):
            target.update(own)
    n, m = sum(raw.values()), sum(target.values())

    def ratio(b: int) -> float:
        share = (raw[b] + 0.5) / (n + 0.5 * 64)
        return math.log((target[b] + 0.5 * 64 * share) / (m + 0.5 * 64) / share)

    for r in q.judged(df, rules).collect():
        own = buckets(texts[r["doc_id"]] or "", rules)
        want = sum(map(ratio, own)) / len(own) if own else 0.0
        assert r["log_ratio"] == pytest.approx(want, abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["log_ratio"] >= rules.threshold)
    kept = {r["doc_id"]: r["kept"] for r in q.judged(df, q.Rules(buckets=64, smoothing=0.5, threshold=-0.1, max_repeat_percent=100)).collect()}
    assert kept[0] and kept[2] and not kept[1]


def test_odd_rows(odd, nothing):
    assert q.judged(nothing).count() == 0
    got = q.judged(odd).collect()
    assert len(got) == odd.count()
    assert all(r["base_failed"] and not r["kept"] for r in got if not (r["text"] or "").strip())


def test_texts_are_cut_up_once_for_the_counts(spark):
    df = spark.createDataFrame([(1, "one two")], "doc_id bigint, text string")
    plan = q.bucket_counts(df, q.Rules())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_trusted_target(spark):
    texts = ["", " ", "a", "a b", "a  b", " a", "a ", " a ", "a b c", "\ta\n b\r", "a b c d", "a b #", "ÀÉÎÕ a b", "ÀÉÎ a b", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for least in range(5):
        for r in df.select("text", q.trusted(q.Rules(trusted_words=least)).alias("t")).collect():
            text = r["text"] or ""
            long_enough = len(re.split(r"[\x20\x09-\x0D]+", text)) >= least
            assert r["t"] == (long_enough and "#" not in text and "ÀÉÎÕ" not in text), (least, text)
