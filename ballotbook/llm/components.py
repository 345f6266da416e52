"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a minimum per node and one join, so a node with any number of links is spread over tasks by
partial aggregation and by the join's skew handling; no neighbour list is gathered. Steps are written to the
shared folder. The rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _state(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected(links: DataFrame, ws: Workspace, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in a link; the component is its smallest node.

    Null ends, self links, repeats and either direction of a link change nothing.
    """
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
        .distinct()
    )
    edges = ws.keep(edges, "links")
    before = _state(edges)
    while before[0]:
        # Large star: all larger neighbours of a node go to its smallest neighbour or itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.filter("v > u").join(least, "u").filter("v > m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = ws.keep(large, "large")
        # Small star: the smaller neighbours of a node, and the node, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        small = ws.keep(small, "small")
        after = _state(small)
        ws.drop(edges, large)
        edges = small
        if after == before:
            break
        before = after
    return (
        edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    )
