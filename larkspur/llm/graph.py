"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import durable, star_join


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of longs to (node, comp), comp the smallest node reachable; a node that is its own comp doesn't appear.

    Null ends and loops are ignored, repeated edges count once; no edges give no rows.
    Each round writes its edges to the checkpoint folder. Least neighbours are found by
    partial aggregation; edges of nodes with very many of them are joined by broadcast.
    """
    star = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, n = None, star.count()
    while True:
        both = star.unionAll(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = durable(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")))
        large = star_join(both.where("b > a"), least, "a", n, "n").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        star = durable(small.where("a <> b").distinct())
        # Stars: no centre is another's leaf, and each leaf has one centre; the sums then stay as they are.
        n, *sums = now = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return star.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        before = now
