"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from convoy.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node reachable. Nodes without edges do not appear.

    ``edges`` has two columns a and b of one ordered type; order, repeats and loops do not matter, edges with a null
    are left out. Alternates large-star and small-star steps, each a minimum per node joined back to
    the edges, until the edges are stars around the least nodes. Every round is written, so lineage
    stays short and a lost executor costs one round at most.
    """
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars = stage(stars, "edges")
    before = None
    while True:
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        stars = stage(small, "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionAll(found.select(F.col("component").alias("node"), "component").distinct())
