"""Connected components of a link table, by alternating large-star and small-star steps.

Cases: null ends and links of a node with itself are left out; repeated links count once;
an empty table has no nodes; nodes without a link do not appear.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) plus m, the least of u and its neighbours v: added up in part before the shuffle."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u").withColumn("m", F.least("u", "m"))


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b: long) -> (node, root) of every node that has a link; root is the least node.

    Every step is two aggregations and joins of the remaining edges and is written out, so
    lineage stays flat; steps go on until nothing changes, about the logarithm of the size.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = cut(edges, "edges"), None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.filter("u <> v").distinct(), "edges")
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        edges = cut(small.filter("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before:
            break
        before = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
