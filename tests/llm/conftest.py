from __future__ import annotations

import pytest

ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one two three"), (5, "one two three"), (5, "one two three"),
    (None, "an id is missing here"), (6, "\n\n\n"), (7, "é▁ü  　x 🎉 \x00 tail "), (8, "word " * 30_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, repeated and very long texts, with extra columns that clash with added ones."""
    rows = [(i, t, "x", 1.5) for i, t in ODD]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, score string, n_words double"
    ).coalesce(2)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
