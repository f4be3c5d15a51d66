"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import kept


def components(links: DataFrame) -> DataFrame:
    """(id, component) for the ends of the links (a, b): the smallest id that can be reached.

    Every round hangs each node's larger neighbours, and itself, on the smallest
    node that it or they know (large and small star), so that trees get flatter at
    both ends; it ends when a round changes nothing. Sums over links tell, no link
    is collected, and every round is a stored table of at most as many links.
    """
    ends = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    links = kept(links.filter("a <> b").select(*ends).distinct())
    before = None
    while True:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: the larger neighbours of a node go to its smallest neighbour.
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: the smaller neighbours of a node, and itself, go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("b", "a")).alias("a"), F.col("m").alias("b"))
        links = kept(small.filter("a <> b").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
