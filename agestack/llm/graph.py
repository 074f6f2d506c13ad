"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import settle


def components(links: DataFrame) -> DataFrame:
    """``v, component`` for every end of the links ``x, y``: the smallest id that can be reached.

    Each round hangs the larger neighbours of a node, then the node and its smaller ones, on the smallest of them, until
    nothing changes; the number of rounds grows with the logarithm of the longest path.  Minima are made before the
    shuffle, so a node with many links is no burden.
    """
    edges = settle(links.select(F.greatest("x", "y").alias("v"), F.least("x", "y").alias("u")).filter("u < v").distinct(), "cc-links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(lowest, "u").select("v", F.col("m").alias("u")).filter("u < v").distinct()
        large = settle(large, "cc-large")
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lowest, "v")
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(lowest.select("v", F.col("m").alias("u")))
        edges = settle(small.filter("u < v").distinct(), "cc-small")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", "u"))).first()
        if now == before:
            break
        before = now
    return edges.select("v", F.col("u").alias("component")).unionByName(
        edges.select(F.col("u").alias("v"), F.col("u").alias("component")).distinct())
