"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of the long pairs ``a``, ``b``; the component is its smallest node.

    Each round links every node's larger neighbours to its smallest one (large star), then every node and
    its smaller neighbours to the smallest of these (small star). Nodes of any degree are aggregated,
    never gathered. Rounds are written to the shared folder, and grow as the logarithm of the longest path.
    """
    pairs = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lows, "a").select(F.explode(F.array(
            F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")) \
            .select("e.*").where("a <> b").distinct()
        after = durable(small, "edges")
        # unchanged, or every node hangs on one root that hangs on nothing: done
        roots = after.select("b").distinct()
        if after.groupBy("a").count().where("count > 1").isEmpty() and after.join(roots.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("b", "b"))
        pairs = after
