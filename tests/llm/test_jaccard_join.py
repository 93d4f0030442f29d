"""The similarity join and the components against brute force."""

from __future__ import annotations

import os
import random
import re

import numpy as np
import pytest
from compare import connect, difference

from tallybook.llm import catalog
from tallybook.llm import jaccard_join as j
from tallybook.llm.components import components

SMALL = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ngrams(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()


def brute(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {i: ngrams(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def documents(seed: int) -> list[tuple[int, str | None]]:
    """Families of edited copies of all sizes, around a line that all share."""
    draw = random.Random(seed)
    shared = [f"s{k}" for k in range(9)]
    out, names = [], iter(draw.sample(range(10_000), 2000))
    for family in range(30):
        base = shared + [f"f{family}w{draw.randrange(400)}" for _ in range(draw.choice([1, 4, 9, 20, 60, 150]))]
        for _ in range(draw.choice([1, 2, 5, 12])):
            own = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                own[draw.randrange(len(own))] = f"e{draw.randrange(50)}"
            out.append((next(names), " ".join(own)))
    return out + [(10_001, None), (10_002, ""), (10_003, " \n"), (10_004, "a b"), (10_005, "A b"), (10_006, "a b c")]


@pytest.mark.parametrize(
    "few, block, more",
    [(256, 1024, {}), (2, 7, {"sampled": 1, "hot": 3}), (0, 3, {}), (4, 1024, {"block_bytes": 3000, "sampled": 2, "hot": 2})],
)
def test_components_of_links(spark, few, block, more):
    docs = documents(few + 1)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, root string")
    got = j.linked(df, j.Settings(few=few, block=block, **more))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == brute(docs)


def test_query_against_sql(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    mine = catalog.queries()["op10_ngram_jaccard_join"](spark, SMALL)
    theirs = connect(SMALL).sql(catalog.oracle_sql()["op10_ngram_jaccard_join"])
    assert difference(mine.toPandas(), theirs.df()) is None


def test_short_unrelated_texts_stay_apart(spark, monkeypatch):
    """Texts that share entries by chance don't become one cluster, whose sets would all be compared."""
    draw = random.Random(8)
    docs = [(i, " ".join(f"w{draw.randrange(5000)}" for _ in range(draw.choice([8, 9, 10])))) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    sizes = []
    checked = j.verified_clusters

    def counted(members, settings):
        sizes.extend(r["count"] for r in members.groupBy("root").count().collect())
        return checked(members, settings)

    monkeypatch.setattr(j, "verified_clusters", counted)
    got = j.linked(df, j.Settings(few=2, block=50))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: r for i, (_, r) in brute(docs).items()}
    assert max(sizes, default=0) <= 4 and sum(sizes) < 150, sorted(sizes)[-5:]


def described(spark, sets: list[np.ndarray]):
    rows = [(k, len(x), j.sketch(x).tolist()) for k, x in enumerate(sets)]
    return spark.createDataFrame(rows, "set_id bigint, n bigint, sketch array<bigint>")


def in_entries(spark, lists: list[list[int]]):
    return spark.createDataFrame([(e, k) for e, own in enumerate(lists) for k in own], "entry bigint, set_id bigint")


@pytest.mark.parametrize("bound, more", [(700, 1.05), (5000, 1.05)])
def test_unrelated_sets_with_sketches_of_unlike_length_are_ruled_out(spark, bound, more):
    """On both sides of a size from which on sketches are longer."""
    draw = np.random.default_rng(bound)
    some = [np.unique(draw.integers(0, 2**63, n).astype(np.uint64)) for n in [int(bound / more)] * 5 + [int(bound * more)] * 5]
    near = np.unique(np.concatenate((some[0], draw.integers(0, 2**63, bound - len(some[0]) + 5).astype(np.uint64))))
    classes = described(spark, [*some, near])
    assert len({len(r["sketch"]) for r in classes.collect()}) == 2
    small = in_entries(spark, [[0, 5], [1, 6], list(range(10)), list(range(11))])
    for got in (j.near_pairs(small, classes, j.Settings()), j.near_in_blocks(small, classes, j.Settings(block=3))):
        assert {frozenset(r) for r in got.collect()} == {frozenset((0, 10))}


def test_connected_classes_of_large_entries_are_not_compared_in_blocks(spark):
    """Only strangers are dealt out, and what is found connects what every pair does."""
    draw = np.random.default_rng(3)
    family = lambda base, n: [np.unique(np.concatenate((base[draw.integers(0, 8) :], draw.integers(0, 2**63, 3).astype(np.uint64)))) for _ in range(n)]
    one, two, alone = (draw.integers(0, 2**63, 300).astype(np.uint64) for _ in range(3))
    sets = family(one, 60) + family(two, 9) + [alone]
    classes = described(spark, sets)
    first = spark.createDataFrame([(e, k, 0) for e in range(20) for k in range(e, 60)], "entry bigint, set_id bigint, first bigint")
    known = components(spark.createDataFrame([(0, k) for k in range(60)], "a bigint, b bigint"))
    assert j.dealt_in_blocks(first, known, classes, j.Settings(block=10)).count() == 0
    mixed = [list(range(e, 60)) for e in range(20)] + [list(range(70)), list(range(50, 70)), [69, 3]]
    got = j.near_in_blocks(in_entries(spark, mixed), classes, j.Settings(block=4))
    pairs = {tuple(sorted(r)) for r in got.collect()}
    groups: dict[int, set[int]] = {}
    for r in components(got).collect():
        groups.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [list(range(60)), list(range(60, 69))]
    assert all((a < 60) == (b < 60) and b < 69 for a, b in pairs)


@pytest.mark.parametrize("population", [10, 10**6, 10**12])
def test_linked_sets_share_an_entry(population):
    settings = j.Settings()
    plan = j.groups(population, settings, largest=4000)
    draw = np.random.default_rng(population % 97)
    for g in plan:
        assert g.segments - 2 * g.skipped + g.deletions > j.most_apart(g.high, g.high, 85)
    for size in (6, 7, 9, 14, 30, 77, 150, 400, 1200, 2500):
        for _ in range(15):
            x = np.unique(draw.integers(0, 2**63, size).astype(np.uint64))
            most = j.most_apart(len(x), len(x), 85)
            gone = draw.integers(0, most + 1)
            y = np.unique(np.concatenate((x[gone:], draw.integers(0, 2**63, most - gone).astype(np.uint64))))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 85 * (len(x) + len(y) - both) and not np.array_equal(x, y):
                shared = np.intersect1d(j.all_entries(x, plan, j.SEED), j.all_entries(y, plan, j.SEED))
                assert len(shared)


def test_sketch_bounds_the_difference():
    draw = np.random.default_rng(4)
    for _ in range(50):
        x, y = (np.unique(draw.integers(0, 300, 200).astype(np.uint64)) for _ in range(2))
        apart = len(np.setxor1d(x, y))
        seen = sum(int(v).bit_count() for v in (j.sketch(x) ^ j.sketch(y)).view(np.uint64))
        assert seen <= apart


def test_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (100, 101)]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    roots: dict[int, set[int]] = {}
    for r in got:
        roots.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, roots.values())) == [list(range(61)), list(range(100, 140))]
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_odd_rows(spark, odd, nothing):
    got = sorted((tuple(r) for r in j.linked(odd).collect()), key=str)
    assert len(got) == odd.count()
    by_id = {r[0]: r[1:] for r in got}
    assert by_id[1] == (0, 1) and by_id[2] == (0, 2) and by_id[3] == (0, 3)
    assert by_id[4] == (1, 4) and by_id[5] == (1, 4)
    assert by_id[8] == (1, 8) and by_id[None] == (2, None)
    assert j.linked(nothing).count() == 0
