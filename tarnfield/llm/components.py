"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.common import durable, forget


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Groups are only reduced by min and joined back, never gathered; a hub's
    rows can be split by the adaptive skew join.  Self links and repeated
    links are harmless; an empty table gives an empty result.
    """
    star = durable(
        edges.filter("a is not null and b is not null")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m"))
        .distinct()
    )
    nodes = star
    seen = None
    while True:
        mark = star.filter("v <> m").agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        seen = mark
        links = star.filter("v <> m")
        both = links.select(F.col("v").alias("u"), F.col("m").alias("w")).union(links.select("m", "v"))
        lowest = both.groupBy("u").agg(F.min("w").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.filter("w > u").join(lowest, "u").select(F.col("w").alias("v"), F.col("low").alias("m")).distinct()
        root = large.groupBy("v").agg(F.min("m").alias("r"))
        small = large.join(root, "v").filter("m <> r").select(F.col("m").alias("v"), F.col("r").alias("m"))
        after = durable(small.union(root.select("v", "r")).distinct())
        if star is not nodes:
            forget(star)
        star = after
    top = star.filter("v <> m").select(F.col("v").alias("node"), F.col("m").alias("component"))
    every = nodes.select(F.col("v").alias("node")).union(nodes.select("m")).distinct()
    return every.join(top, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
