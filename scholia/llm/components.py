"""Connected components of links, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import cut, forget


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, component), component being the smallest node reachable; only nodes with a link.

    Alternating large and small stars: every node hands its larger, then its smaller neighbours to the smallest node it
    knows, until nothing changes. Rounds grow with the logarithm of the longest chain; each is written to the shared folder.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, now = now, cut(small.filter("u <> v").distinct(), "edges")
        forget(last)
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = cut(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
    forget(now)
    return found
