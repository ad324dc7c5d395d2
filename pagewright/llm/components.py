"""Connected components of an edge table, by rounds of DataFrame joins.

Every round gives each node the smallest label among its neighbours (aggregated
before the shuffle, so a hub costs one row a task) and then jumps: a node takes the
label of its label. Rounds stop when nothing changes; labels are node ids, so the
result is the smallest id of a component. Each round is written to the shared folder.
Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``edges``; the edges need not be distinct or directed."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    star = scratch.written(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    # Alternate: (1) larger neighbours of a node join its smallest neighbour, (2) smaller ones too.
    while True:
        every = star.union(star.select("v", "u"))
        least = every.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = every.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.written(large.where("u != v"), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        small = scratch.written(small.select("e.*").where("u != v").distinct(), "small")
        # Done when every node hangs on a root: no parent has a parent, and one parent a node.
        deep = small.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() or small.join(small.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        star = small
        if not deep:
            roots = star.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
            return star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
