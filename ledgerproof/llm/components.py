"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerproof.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, root: for every node of `edges` (a, b) the least node that it is linked with, over any number of links.

    Alternates two steps until nothing changes: link every larger neighbour of a node to the least of its
    neighbours and itself, then every neighbour that isn't larger. Each step is an aggregation with a
    combining step and a join that adaptive execution may split, so a node with very many links is no
    task of its own. What each round leaves is written to the shared folder.
    """
    links = materialise(edges.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).filter("high != low").distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy("high").agg(F.least(F.min("low"), F.first("high")).alias("least"))
        larger = both.join(least, "high").filter("low > high").select(F.col("low").alias("high"), F.col("least").alias("low")).distinct()
        least = larger.groupBy("high").agg(F.min("low").alias("least"))
        smaller = larger.join(least, "high").select(F.col("low").alias("high"), F.col("least").alias("low"))
        links = smaller.unionByName(least.withColumnRenamed("least", "low")).filter("high != low").distinct()
        links = materialise(links, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("high").alias("node"), F.col("low").alias("root"))
        before = now
