"""Connected components of a graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimora.llm.shared import dropped, saved


def connected(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node that reaches it, for each node of edges(a, b) that
    isn't the smallest of its component; loops and nulls are ignored.

    Each round links every node to the least neighbour it knows of; the number of rounds follows
    the logarithm of the longest path. Least neighbours are partial aggregates, so a node with
    very many neighbours doesn't gather them in one task.
    """
    ordered = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, mark = saved(ordered.distinct(), "edges"), None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == mark or not found[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = tuple(found)
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "c")
        large = saved(now.join(least, now["v"] == least["c"]).select("u", F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = saved(least.select("u", F.col("m").alias("v")).union(rest).distinct(), "small")
        dropped(now)
        dropped(large)
        now = after
