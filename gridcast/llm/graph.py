"""Connected components of a long-typed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.session import snapshot


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (columns a, b); root is the smallest vertex of its component.

    Each round joins every vertex to the least of its neighbours; the number of rounds grows with the logarithm of the
    vertices. Minima combine before the shuffle, so a vertex with very many links is cheap there, and the joins that
    follow are split by adaptive execution. The driver only compares two numbers per round. Rounds are written to the
    shared folder, so nothing is recomputed when an executor is lost.
    """
    now = snapshot(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).distinct()
    )
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "w")), F.sum(F.hash("v", "w").cast("long"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = now.unionByName(now.select(F.col("w").alias("v"), F.col("v").alias("w")))
        least = both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").filter("w > v and w <> m").select(F.col("w").alias("v"), F.col("m").alias("w"))
        large = snapshot(large.distinct())
        # Small star: the neighbours below a vertex, and the vertex itself, point at the least of them.
        least = large.groupBy("v").agg(F.min("w").alias("m"))
        small = large.join(least, "v").filter("w <> m").select(F.col("w").alias("v"), F.col("m").alias("w"))
        now = snapshot(small.unionByName(least.select("v", F.col("m").alias("w"))).distinct())
    ends = now.select("v", F.col("w").alias("root"))
    return ends.unionByName(now.select(F.col("w").alias("v"), F.col("w").alias("root")).distinct())
