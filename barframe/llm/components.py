"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.llm.shared import written


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``component`` (the smallest node it reaches) for every node of ``links``.

    ``links`` has long columns ``a`` and ``b``; order and repeats don't matter, null ends and loops
    are ignored.  Rounds of large-star and small-star: a node with many neighbours is handled by
    a minimum that is combined before the shuffle and by a join, so no neighbourhood is gathered.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: neighbours that are greater than u move to the least of u's neighbourhood
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its lesser neighbours move to the least of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u <> v").distinct(), name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
