"""Operators against plain Python on frames with ties, NULLs and hot keys."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from frames import frame, tuples
from pyspark.sql import functions as F

from tallybook import operators as ops


def _ranked(rows: list[tuple]) -> list[tuple]:
    """Rank by value downwards (missing last), then by name (missing last)."""
    ordered = sorted(
        rows,
        key=lambda r: (r[1] is None, -(r[1] or 0), r[0] is None, r[0] or ""),
    )
    return sorted(
        [(name, value, place) for place, (name, value) in enumerate(ordered, 1)], key=lambda r: r[2]
    )


@pytest.mark.parametrize("ranker", [ops.global_rank, ops.range_rank])
@pytest.mark.parametrize("spread", [1, 7, 1000])
def test_rank_with_heavy_ties(spark, ranker, spread):
    random.seed(spread)
    rows = [(f"k{i:05d}", random.randrange(spread)) for i in range(2000)]
    rows += [(f"n{i:05d}", None) for i in range(1000)] + [(None, 3)]
    df = frame(spark, "k string, v int", rows).repartition(13)
    got = tuples(ranker(df, [ops.descending("v"), ops.ascending("k")], "r"), "k", "v", "r")
    assert sorted(got, key=lambda r: r[2]) == _ranked(rows)


def test_range_rank_of_nothing(spark):
    df = frame(spark, "k string, v int", [("a", 1)]).filter("v > 5")
    assert ops.range_rank(df, [ops.descending("v"), ops.ascending("k")], "r").count() == 0


def test_range_rank_uses_many_partitions(spark):
    df = spark.range(200000).select((F.col("id") % 3).alias("v"), F.col("id").alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = ops.range_rank(df, [ops.ascending("v"), ops.ascending("k")], "r")
        widest = (
            ranked.groupBy(F.spark_partition_id()).count().agg(F.max("count")).collect()[0][0]
        )
        assert widest < 100000
        assert ranked.agg(F.min("r"), F.max("r"), F.count_distinct("r")).collect()[0] == (
            1,
            200000,
            200000,
        )
        wrong = ranked.filter((F.col("v") * 66667 - F.col("r") > 66667) | (F.col("r") < 1))
        assert wrong.count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_share_of_total(spark):
    df = frame(spark, "k string, a int, b int", [("x", 1, 0), ("y", 3, 0)])
    got = tuples(ops.share_of_total(df, {"sa": "a", "sb": "b"}), "k", "sa", "sb")
    assert sorted(got) == [("x", 0.25, None), ("y", 0.75, None)]


def test_pivot_keeps_closed_domain(spark):
    df = frame(spark, "k string, c string, v int", [("x", "p", 1), ("x", "p", 2), ("y", "q", 5)])
    wide = ops.pivot_with_total(df, "k", "c", ["p", "q", "r&s"], F.sum("v"))
    assert wide.columns == ["k", "p", "q", "r&s", "Total"]
    assert sorted(tuples(wide)) == [("x", 3, 0, 0, 3), ("y", 0, 5, 0, 5)]
    shared = ops.add_shares(wide, {"p": "sp", "r&s": "srs"})
    assert sorted(tuples(shared, "k", "sp", "srs")) == [("x", 1.0, 0.0), ("y", 0.0, 0.0)]


def test_total_row_differs_from_null_key(spark):
    df = frame(spark, "k string, v int", [("x", 1), (None, 2)])
    got = tuples(ops.total_row(df, "k", ["v"]), "k", "v", "IsTotal")
    assert sorted(got, key=str) == [("Total", 3, 1), ("x", 1, 0), (None, 2, 0)]


def test_total_row_per_outer_key(spark):
    df = frame(spark, "o string, k string, v int", [("a", "x", 1), ("a", "y", 2), ("b", "x", 5)])
    got = tuples(ops.total_row(df, "k", ["v"], extra_keys=("o",)), "o", "k", "v")
    assert sorted(got) == [
        ("a", "Total", 3), ("a", "x", 1), ("a", "y", 2), ("b", "Total", 5), ("b", "x", 5),
    ]


def test_two_level_with_null_inner_key_and_hot_group(spark):
    rows = [("hot", f"s{i % 50}", 1) for i in range(3000)] + [("hot", None, 1), ("b", "s1", 2)]
    got = tuples(
        ops.two_level(frame(spark, "o string, i string, v int", rows), ["o"], ["i"], "n", ["v"])
    )
    assert sorted(got) == [("b", 1, 2), ("hot", 51, 3001)]


def test_group_with_attribute(spark):
    df = frame(spark, "k string, a string, v int", [("x", "2", 1), ("x", "1", 4), ("y", None, 5)])
    got = tuples(ops.group_with_attribute(df, "k", "a", {"s": F.sum("v")}))
    assert sorted(got) == [("x", "1", 5), ("y", None, 5)]


@pytest.mark.parametrize("n", [1, 2, 7, 189])
def test_quartiles_cut_at_n_quarters(spark, n):
    df = spark.range(1, n + 1).withColumnRenamed("id", "r")
    got = dict(tuples(ops.rank_bands(df, "r", "q"), "r", "q"))
    assert got == {r: math.ceil(4 * r / n) for r in range(1, n + 1)}


def test_bands_from_given_cuts(spark):
    df = spark.range(1, 130).withColumnRenamed("id", "r")
    got = Counter(q for _, q in tuples(ops.rank_bands(df, "r", "q", cuts=[32.5, 65.5, 97.5])))
    assert got == {1: 32, 2: 33, 3: 32, 4: 32}


def test_flag_ranks(spark):
    df = spark.range(1, 6).withColumnRenamed("id", "r")
    got = dict(tuples(ops.flag_ranks(df, "r", [2, 5], "mark")))
    assert [got[i] for i in range(1, 6)] == ["Other", "CaseStudy", "Other", "Other", "CaseStudy"]


def test_head_tail_and_nth(spark):
    df = ops.global_rank(
        frame(spark, "k string, v int", [(c, i) for i, c in enumerate("abcdefg")]),
        [ops.ascending("v")],
        "r",
    )
    both = ops.head_and_tail(df, "r", 2, 3)
    assert sorted(tuples(both, "End", "k")) == [
        ("head", "a"), ("head", "b"), ("tail", "e"), ("tail", "f"), ("tail", "g"),
    ]


def test_nth_rows_per_group(spark):
    rows = [("g", c, i) for i, c in enumerate("abcdefg")] + [("h", "z", 1)]
    df = frame(spark, "g string, k string, v int", rows)
    got = ops.nth_rows(df, ["g"], [ops.descending("v")], [1, 2, 4, 99])
    assert sorted(tuples(got, "g", "k", "_position")) == [
        ("g", "d", 4), ("g", "f", 2), ("g", "g", 1), ("h", "z", 1),
    ]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_restrict_to_list_equals_left_join(spark):
    listed = frame(spark, "k string", [("a",), ("b",), ("b",), (None,)])
    facts = frame(spark, "k string, v int", [("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 5)])
    got = tuples(ops.restrict_to_list(listed, facts, "k"), "k", "v")
    want = tuples(listed.join(facts, "k", "left"), "k", "v")
    assert sorted(got, key=str) == sorted(want, key=str)


def test_exclude_drops_listed_and_missing(spark):
    df = frame(spark, "k string", [("a",), ("b",), (None,)])
    assert tuples(ops.exclude(df, "k", ["b"])) == [("a",)]
    assert len(tuples(ops.exclude(df, "k", []))) == df.count()  # nothing is excluded


def test_unique_key_passes_and_fails(spark):
    good = frame(spark, "k string, v int", [("a", 1), ("b", 2), (None, 3)])
    assert sorted(tuples(ops.unique_key(good, "k")), key=str) == sorted(tuples(good), key=str)
    with pytest.raises(Exception, match="1 *values of k repeated|values of k repeated"):
        ops.unique_key(frame(spark, "k string", [("a",), ("a",)]), "k").collect()


def test_a_repeated_key_fails_every_guarded_join(spark):
    rows = frame(spark, "k string, v int", [("a", 1)])
    twice = frame(spark, "k string, w int", [("a", 1), ("a", 2)])
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for limit in ("10m", "-1"):
        for key in keys:
            spark.conf.set(key, limit)
        try:
            with pytest.raises(Exception, match="repeated in a dimension"):
                ops.attach(rows, twice, "k").collect()
        finally:
            for key in keys:
                spark.conf.unset(key)


def test_pivot_fails_on_a_value_off_the_list(spark):
    rows = frame(spark, "k string, c string, v int", [("a", "x", 1), ("a", "new", 2)])
    with pytest.raises(Exception, match="c has a value off its list: new"):
        ops.pivot_with_total(rows, "k", "c", ["x", "y"], F.sum("v")).collect()
    missing = frame(spark, "k string, c string, v int", [("a", None, 1)])
    with pytest.raises(Exception, match="off its list: NULL"):
        ops.pivot_with_total(missing, "k", "c", ["x"], F.sum("v")).collect()


def test_building_a_rank_runs_no_job(spark):
    df = frame(spark, "k string, v int", [("a", 1), ("b", 2)])
    spark.sparkContext.setJobGroup("rank", "rank")
    try:
        ops.range_rank(df, [ops.descending("v"), ops.ascending("k")], "r")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("rank")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("unique", ["Supplier#%09d", "%d"])
def test_range_rank_parts_are_bounded(spark, unique):
    """Neither a shared value nor a common beginning of names fills a part, at any size."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        for rows in (4_000, 40_000):
            df = spark.range(rows).select(
                F.when(F.col("id") % 4 > 0, 5).otherwise(F.col("id") % 3).alias("v"),
                F.format_string(unique, "id").alias("k"),
            )
            keys = [ops.descending("v"), ops.ascending("k")]
            ranked = ops.range_rank(df, keys, "r", part_rows=500, samples=20)
            placed = ranked.groupBy(F.spark_partition_id()).agg(F.count("r").alias("n"), F.max("r").alias("last"))
            parts = placed.filter("last > 0").agg(F.max("n"), F.count("n")).first()
            # Parts have about 500 rows; a task gets a few of them by chance.
            assert parts[0] < 4_000 and parts[1] >= min(rows // 500, 60) * 0.6
            want = [r[0] for r in df.orderBy(F.desc("v"), "k").select("k").collect()]
            assert [r["k"] for r in ranked.orderBy("r").select("k").collect()] == want
            assert ranked.agg(F.min("r"), F.max("r"), F.count_distinct("r")).first() == (1, rows, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_range_rank_by_three_keys(spark):
    random.seed(9)
    draw = lambda n: random.choice([None, *range(n)])
    rows = [(draw(3), draw(4), f"k{i}") for i in range(3000)]
    keys = [ops.ascending("a"), ops.descending("b"), ops.ascending("k")]
    got = ops.range_rank(frame(spark, "a int, b int, k string", rows), keys, "r", part_rows=100, samples=10)
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, -(r[1] or 0), r[2]))
    assert [r[:3] for r in sorted(tuples(got, "a", "b", "k", "r"), key=lambda r: r[3])] == want


def test_keys_present(spark):
    df = frame(spark, "k string, v int", [("a", 1), ("a", 1), (None, 2), ("b", None)])
    assert sorted(tuples(ops.keys_present(df, "k")), key=str) == [("a",), ("b",), (None,)]
    assert sorted(tuples(ops.keys_present(df, "k", F.max("v").alias("m"))), key=str) == [("a", 1), ("b", None), (None, 2)]
