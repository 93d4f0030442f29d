"""Whitening against plain linear algebra in whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tallybook.llm import spectrum, whitening


def test_counts_follow_the_spectrum():
    draw = np.random.default_rng(0)
    for turn in range(200):
        size = int(draw.integers(1, 14))
        a = draw.normal(size=(size, size))
        a = a + a.T
        if turn % 3 == 0:
            np.fill_diagonal(a, 0)
        values = np.linalg.eigvalsh(a)
        assert spectrum.inertia(a) == ((values > 0).sum(), (values < 0).sum())


@pytest.mark.parametrize("size", [1, 2, 5, 64, 100])
def test_leading_pairs(size):
    a = np.random.default_rng(size).normal(size=(size, size))
    a = a @ a.T / size
    values, vectors = spectrum.leading(a, 16)
    want = np.linalg.eigvalsh(a)[::-1][:16]
    assert np.abs(values - want).max() <= 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-9
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * want[0]


def test_equal_and_close_eigenvalues():
    turn = np.linalg.qr(np.random.default_rng(3).normal(size=(9, 9)))[0]
    for spread in ([5, 5, 5, 3, 3, 1, 0, 0, 0], [2, 2 - 1e-7, 2 - 2e-7, 1, 1, 1, 1, 1, 1], [1] * 9):
        a = turn @ np.diag(np.array(spread, float)) @ turn.T
        for wanted in (2, 4, 9):
            values, vectors = spectrum.leading(a, wanted)
            assert np.abs(values - spread[:wanted]).max() < 1e-13 * 10
            assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-6
    assert spectrum.leading(np.zeros((3, 3)), 2)[0].tolist() == [0, 0]


def brute(rows, settings):
    """Rows by id and component, from whole numbers and a library's eigenvalues; signs are free."""
    kept = []
    for name, vector in rows:
        if vector is not None and all(c is not None and math.isfinite(c) for c in vector):
            kept.append((name, [math.floor(settings.steps * c) + settings.shift for c in vector]))
    distinct = [list(x) for x in {tuple(x) for _, x in kept}]
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[n * c - s for c, s in zip(x, sums)] for x in distinct], float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for name, x in kept:
        apart = [n * c - s for c, s in zip(x, sums)]
        for k in range(min(settings.components, len(sums))):
            e, u = values[-1 - k], vectors[:, -1 - k]
            out[name, k + 1] = (n, sum(a * a for a in apart), abs(np.array(apart) / n @ u) / math.sqrt(e), e / values.sum())
    return out


def test_whitened_rows(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(c) for c in draw.normal(size=20) * np.linspace(3, 0.5, 20)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # a vector that a third of the rows share
    odd = [(2000, None), (2001, [None] * 20), (2002, [float("nan")] * 20), (2003, [float("inf")] + [0.0] * 19)]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows + odd], "vec_id bigint, embedding array<float>, n double")
    got = whitening.whitened(df).collect()
    single = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    want = brute(single, whitening.Settings())
    assert {(r["vec_id"], r["component"]) for r in got} == set(want)
    assert len(got) == len(want)
    for r in got:
        n, deviation, size, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert math.isclose(abs(r["whitened"]), size, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r["explained"], explained, rel_tol=1e-9)
        assert r["identity_error"] < 1e-9


def test_odd_tables(spark):
    kind = "vec_id bigint, embedding array<double>, component string"
    assert whitening.whitened(spark.createDataFrame([], kind)).count() == 0
    equal = [(i, [1.0, 2.0], "x") for i in range(5)]
    assert whitening.whitened(spark.createDataFrame(equal, kind)).count() == 0
    # Lengths apart, an empty vector, a null id, repeated rows, and entries without bound.
    rows = [(1, [1.0, 2.0], ""), (1, [1.0, 2.0], ""), (None, [3.0, 2.0], ""), (4, [], ""), (5, [1.0], ""), (6, [1e300], "")]
    got = whitening.whitened(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in got) == [(0, 1, 2), (1, 1, 2), (1, 1, 2), (5, 1, 2), (6, 1, 2)]
    assert [r["deviation"] for r in got if r["vec_id"] == 6] == [(LIMIT_STEPS - 64) ** 2 if (LIMIT_STEPS - 64) ** 2 < 1 << 63 else None]
    assert {abs(round(r["whitened"], 6)) for r in got} == {1.0}


LIMIT_STEPS = 1 << 53


def test_sums_in_pieces(spark):
    from tallybook.llm import sums

    df = spark.range(1000).repartition(37)

    def partial(batches):
        out = np.zeros((3, 5000), np.int64)
        for b in batches:
            out[1] += b["id"].to_numpy().sum()
            out[2, :7] += len(b)
        return out

    got = sums.summed(df, partial, (3, 5000), np.int64, sides=4)
    assert (got[0] == 0).all() and (got[1] == 499500).all() and got[2].sum() == 7000
