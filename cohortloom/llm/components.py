"""Connected components by alternating stars, in rounds written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def _state(edges: DataFrame) -> tuple:
    """Count and checksum of an edge table without repeated rows."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _lows(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the least of a and its b's: a hot ``a`` is summed before it meets."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    return pairs.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is the least node.

    Edges with a null end or both ends equal are void; repeated edges count
    once.  Large and small stars alternate until nothing changes, a logarithmic
    number of rounds in practice.  Each round is written once, so a lost
    executor costs no more than the round.
    """
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    stars = cut(ends.where("a < b").distinct())
    before = _state(stars)
    while before[0]:
        both = stars.union(stars.select("b", "a"))
        large = _lows(both).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # Here a is the greater end of each edge.
        joined = _lows(large.where("a <> b").distinct())
        small = joined.select(F.col("b").alias("a"), F.col("low").alias("b")) \
            .union(joined.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        stars = cut(small.select(F.col("b").alias("a"), F.col("a").alias("b")))
        after = _state(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("b").alias("node"), F.col("a").alias("root")) \
        .union(stars.select("a", "a").distinct())
