"""Connected components of a link table, by alternating stars.

Every round rewires each node to the smallest neighbour it knows: first all larger
neighbours, then all smaller ones. The table stays as long as the number of
links, a star costs one aggregate and one join on the node (both split hot nodes:
the aggregate combines before its shuffle, adaptive execution splits the join), and
the number of rounds grows with the logarithm of the longest chain. Each round is
written to the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.session import cut_lineage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links``: (u, v) with u > v. One star operation, again as u > v."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    joined = both.join(least, "u")
    moved = joined.where("v > u" if large else "v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    if not large:
        moved = moved.union(least.select("u", F.col("low").alias("v")))
    return moved.where("u != v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    Null ends and links of a node with itself are ignored; an empty table gives an empty result.
    """
    edges = cut_lineage(
        links.where(f"{a} != {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links"
    )
    before = None
    while True:
        edges = cut_lineage(_star(_star(edges, True), False), "links")
        # a star forest no longer changes; the number and sum of its links then repeat
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
