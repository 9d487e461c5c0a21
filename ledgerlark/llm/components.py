"""Connected components of a link table, by alternating large-star and small-star steps
(Kiveris and others, "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.storage import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node reached.

    Rows with a null end or two equal ends link nothing. Repeated links count once. Without links
    the result is empty. Each round is a few grouped minima and joins on the node; a node with very
    many links is pre-aggregated before its shuffle, and its join is one that AQE can split.
    """
    edges = edges.select(F.col(left).cast("long").alias("l"), F.col(right).cast("long").alias("r")).where("l <> r")
    edges = stored(edges.select(F.greatest("l", "r").alias("a"), F.least("l", "r").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = stored(small.select("e.*").where("a <> b").distinct())
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
