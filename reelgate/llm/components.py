"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgate.session import pinned


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node that ``links`` (a, b) names.

    Every pass hangs the larger neighbours of each node, then the smaller ones, onto the
    smallest node seen; the number of passes grows with the logarithm of the longest path. Each
    pass is a stored table, so nothing but counts comes to the driver and lost executors cost
    one pass. Least neighbours are found by a combining aggregate and joined back, hence a node
    with very many links is no single task's work.
    """
    edges = pinned(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = pinned(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        seen = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if seen == mark:
            break
        mark = seen
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


