"""Connected components of links, by alternating stars: joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of links(a, b), a stored table; the component is its least node.

    A round links each node's greater neighbours to the least of its neighbourhood (a large star), then each node and its
    lesser neighbours to the least of these (a small star). Both keep what is connected and hang nodes lower; once every
    node with a parent has one and no child, each hangs from the least of its component alone. Each round's links are stored,
    and so are the least neighbours, so that the rows of a node with very many neighbours can be split over tasks; only
    whether rounds are left reaches the driver.
    """
    edges = first = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(near, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).distinct()
        moved = stored(small)
        discard(near, *(() if edges is first else (edges,)))
        edges = moved
        # Stars it is, once every node with a parent has one, and no child.
        low = edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").select("a")
        if low.union(edges.groupBy("a").count().where("count > 1").select("a")).isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
