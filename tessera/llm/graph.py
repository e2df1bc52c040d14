"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _lowest(edges: DataFrame, key: str, other: str) -> DataFrame:
    """Per key, the least of itself and its others."""
    return edges.groupBy(key).agg(F.least(F.min(other), F.col(key)).alias("low"))


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node reachable) of every node in the links (a, b: long). Large-star and small-star
    steps by turns: every step hooks nodes to the least node known around them, until nothing changes. Each step is two
    aggregations with partial sums and two joins, so a node with very many links is no single task's work."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lowest(both, "u", "v"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u != v").distinct()
        low = _lowest(large, "u", "v")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
        new = cut(small.filter("u != v").distinct())
        drop_cut(edges)
        edges = new
        r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (r.n, r.h) == state:
            break
        state = (r.n, r.h)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = cut(nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct()))
    drop_cut(edges)
    return out
