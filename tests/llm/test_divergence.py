"""Source divergence against plain Python and SQL."""

from __future__ import annotations

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, difference

from tallybook.llm import catalog, divergence

SMALL = "/root/testdata/sf0.01"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows: list[tuple], settings: divergence.Settings) -> set[tuple]:
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = TERM.findall(lowered)
        counts[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = set()
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in held[lang].items() if n >= settings.documents]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        whole = sum(groups.values(), Counter())

        def shares(c):
            n = sum(c[t] for t in kept) + settings.smooth * len(kept)
            return {t: 1 + settings.scale * (c[t] + settings.smooth) // n for t in kept}

        q, p = shares(whole), {s: shares(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {
                    (lang, s, part, item, value, k)
                    for k, (value, item) in enumerate(found, 1)
                    if part == "pair" or k <= settings.top
                }
    return out


def audited(spark, rows, settings) -> list[tuple]:
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    return [tuple(r) for r in divergence.audited(df.selectExpr("*", "1 AS term", "'x' AS n"), settings).collect()]


@pytest.mark.parametrize("cells", [1 << 21, 8])
def test_against_plain_python(spark, cells):
    random.seed(cells)
    settings = divergence.Settings(documents=3, top=4, cells=cells, salts=3)
    words = ["".join(random.choices("abÀé日", k=random.randrange(1, 4))) for _ in range(60)] + ["Same", "sAME", "same"]
    rows = []
    for k in range(400):
        source = "hot" if k % 3 == 0 else random.choice(["s1", "s2", "ü", "", None])
        lang = random.choice(["en", "de", None])
        rows.append((lang, source, " ".join(random.choices(words, k=random.randrange(0, 30)))))
    rows += [("xx", "a", "too rare"), ("xx", "b", None), ("xx", "c", ""), ("en", "dry", "123 ?!"), ("one", "only", "w w w")] * 2
    rows += [("one", "only", "w"), ("en", "long", "lengthy " * 20_000)]
    got = audited(spark, rows, settings)
    want = brute(rows, settings)
    assert len(got) == len(want) and set(got) == want


def test_empty_table(spark):
    assert audited(spark, [], divergence.Settings()) == []


def test_query_against_sql(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    mine = catalog.queries()["op11_source_divergence_audit"](spark, SMALL)
    theirs = connect(SMALL).sql(catalog.oracle_sql()["op11_source_divergence_audit"])
    assert difference(mine.toPandas(), theirs.df()) is None


@pytest.mark.parametrize("top", [1, 3, 50])
def test_skyband(top):
    draw = np.random.default_rng(top)
    for size in (0, 1, 40, 700):
        n, lang_n = draw.integers(1, 30, size), draw.integers(1, 60, size)
        terms = np.array([f"{k:05d}".encode() for k in draw.permutation(size)], object)
        dominators = [
            sum(n[j] >= n[i] and lang_n[j] <= lang_n[i] and terms[j] < terms[i] for j in range(size)) for i in range(size)
        ]
        want = [i for i in range(size) if dominators[i] < top]
        assert sorted(divergence.skyband(n, lang_n, terms, top, block=16).tolist()) == want


def test_long_division():
    settings = divergence.Settings()
    for c, n in ((0, 10), (9, 10), (10**12, 10**13 + 7), (3, 7), (2 * 10**14, 8 * 10**14 + 1)):
        assert divergence.share(np.array([c]), np.array([n]), settings)[0] == 1 + 10**9 * (c + 5) // n
    odd = divergence.Settings(scale=50_000)
    assert divergence.share(3, 7, odd) == 1 + 50_000 * 8 // 7
