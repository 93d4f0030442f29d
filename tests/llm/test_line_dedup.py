"""Line dedup against plain Python and SQL; the filters against sets."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from compare import connect, difference

from tallybook.llm import catalog, line_dedup, twice_seen

BLANKS = " \t\n\x0b\x0c\r"


def key_of(line: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows: list[tuple], settings: line_dedup.Settings) -> list[tuple]:
    """``(id, text)`` rows to ``(id, n_lines, n_dropped, kept)``."""
    name = lambda i, t: (i is not None, i if i is not None else t or "")
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= settings.min_chars:
                holders[key_of(line)].add(name(i, t))
    last = {k: max(h, key=lambda x: (x[0], x[1] if x[0] else 0)) for k, h in holders.items() if len(h) >= settings.documents}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [line for line in lines if last.get(key_of(line), name(i, t)) == name(i, t)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def dropped(spark, rows, settings) -> list[tuple]:
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id bigint, text string, n_lines int").repartition(5)
    got = line_dedup.deduplicated(df, settings)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped", "kept"]
    return [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got.collect()]


order = lambda r: (r[0] is not None, r[0] or 0, r[3], r[2])


@pytest.mark.parametrize("most_bits", [1 << 30, 256])
def test_against_plain_python(spark, most_bits):
    random.seed(most_bits)
    settings = line_dedup.Settings(min_chars=6, documents=3, most_bits=most_bits)
    pool = [random.choice(["", "  ", "\t"]) + random.choice("aÀB") * n + random.choice(["", " \r", "\x0b"]) for n in range(3, 12)]
    rows = [(k, "\n".join(random.choices(pool, k=random.randrange(0, 9)))) for k in range(300)]
    # A line that most documents have, rows of one id, a long text, and odd ones.
    rows = [(i, t + "\nShared by Most") if i % 3 else (i, t) for i, t in rows]
    rows += [(7, "SHARED by most"), (7, None), (299, "aaaaaaaa\nshared by most"), (400, None), (401, ""), (402, "\n\n")]
    rows += [(500, "\n".join(pool * 500))]
    assert sorted(dropped(spark, rows, settings), key=order) == sorted(brute(rows, settings), key=order)


def test_rows_without_an_id(spark):
    settings = line_dedup.Settings(min_chars=4, documents=3)
    rows = [(None, "same line\nx"), (None, "same line\nx"), (None, "same line\ny"), (3, "same line")]
    got = sorted(dropped(spark, rows, settings), key=order)
    assert got == [(None, 2, 1, "x"), (None, 2, 1, "x"), (None, 2, 1, "y"), (3, 1, 0, "same line")]
    assert dropped(spark, rows[:2], settings) == [(None, 2, 0, "same line\nx")] * 2


def test_empty_table(spark, nothing):
    assert line_dedup.deduplicated(nothing).count() == 0


def test_odd_rows(spark, odd):
    got = line_dedup.deduplicated(odd)
    assert got.count() == odd.count() and got.filter("n_dropped <> 0").count() == 0


def test_query_against_sql(spark, sf_dir):
    mine = catalog.queries()["op13_line_dedup"](spark, sf_dir)
    theirs = connect(sf_dir).sql(catalog.oracle_sql()["op13_line_dedup"])
    assert difference(mine.toPandas(), theirs.df()) is None


def test_filters(spark):
    lists = [(list(range(k, k + 3)),) for k in range(0, 3000, 3)] + [([5, 7, 100],), ([-9],), ([],)]
    df = spark.createDataFrame(lists, "h array<bigint>").repartition(6)
    for bits in (1 << 15, 1 << 22):
        once = twice_seen.seen(df, bits, twice=False)
        twice = twice_seen.seen(df, bits)
        hashes = np.array([*range(3000), -9], np.int64).view(np.uint64)
        assert twice_seen.may_hold(once, hashes).all()
        assert twice_seen.may_hold(twice, np.array([5, 7, 100], np.uint64)).all()
        assert twice_seen.may_hold(twice, hashes).mean() < 0.2
        assert twice_seen.may_hold(once, np.arange(10**6, 10**6 + 2000, dtype=np.uint64)).mean() < 0.2
    assert not twice_seen.seen(df.filter("false"), 1 << 16).any()


def test_a_hash_twice_in_one_task(spark):
    df = spark.createDataFrame([([1, 2],), ([2, 3],)], "h array<bigint>").coalesce(1)
    twice = twice_seen.seen(df, 1 << 16)
    assert twice_seen.may_hold(twice, np.array([1, 2, 3], np.uint64)).tolist() == [False, True, False]
