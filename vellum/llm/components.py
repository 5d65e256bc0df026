"""Connected components of a link table, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every end of the links ``a, b``: the least node reachable.

    Large-star and small-star rounds alternate: each node's greater, then its
    lesser neighbours are hung on its least one. The links form stars after a
    logarithmic number of rounds. Every round is one pre-aggregated minimum and
    one join; a hub's neighbours are never gathered in one place.
    """
    both = links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges, before = cut(both.distinct()), None
    while not edges.isEmpty():
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("m").alias("a"), "b")
        large = large.filter(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select("m", F.explode(F.array("a", "b")).alias("b")).filter(F.col("m") != F.col("b"))
        edges = cut(small.select(F.col("m").alias("a"), "b").distinct())
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
