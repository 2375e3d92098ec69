"""Connected components of a link table, without gathering a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspark.llm.common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, comp`` of every linked node: ``comp`` is the smallest node
    reachable.  Alternating large and small stars: each round hangs a node's
    neighbours on the smallest of them; rounds grow with the logarithm of the
    longest path, and every step is a grouped minimum and a join.  Each round
    is written to the shared folder, so a lost executor repeats one round."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, "cc_edges")
    last = None
    while True:
        # large star: greater neighbours go to the smallest of neighbours and self
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lu"), F.least("u", "m").alias("m")), "cc_least")
        large = both.filter("v > u").join(least, F.col("u") == F.col("lu")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc_large")
        # small star: smaller neighbours and self go to the smallest of them
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lu"), "m"), "cc_least")
        hung = large.join(least, F.col("u") == F.col("lu")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = hung.unionByName(least.select(F.col("lu").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = materialize(edges, "cc_edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if tuple(now) == last:
            break
        last = tuple(now)
    # every edge is now (node, smallest node)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
