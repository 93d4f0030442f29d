"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.storage import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (``a``, ``b``; long); one root per component.

    In each round every node joins the neighbour, or itself, that comes first in
    an order drawn anew by hash, and edges are contracted. That shrinks chains
    as well as stars by a constant share, so rounds grow with the logarithm of
    the longest chain. Loops and repeated edges do no harm.
    """
    own = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    turn = 0
    while not own.isEmpty():
        both = own.union(own.select("b", "a")).toDF("node", "next")
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("n"))
        nearest = both.groupBy("node").agg(F.min(rank("next")).alias("m"))
        joined = nearest.select("node", F.least(F.col("m"), rank("node"))["n"].alias("root"))
        joined = stored(joined, "roots")
        if labels is None:
            labels = joined
        else:
            moved = joined.select(F.col("node").alias("root"), F.col("root").alias("further"))
            labels = stored(
                labels.join(moved, "root", "left").select("node", F.coalesce("further", "root").alias("root")),
                "labels",
            )
        a = joined.withColumnsRenamed({"node": "a", "root": "ra"})
        b = joined.withColumnsRenamed({"node": "b", "root": "rb"})
        own = own.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        own = stored(own.filter("a <> b").distinct(), "edges")
        turn += 1
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node bigint, root bigint")
    return labels
