"""Connected components of undirected links (A16): large-star and small-star steps over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.storage import stored


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable from each node with a link in ``edges`` (a, b).

    Every step groups by minimum only, which combines before its shuffle; each round's links are written to shared storage.
    """
    links = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        turned = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        links = stored(large.join(low, "u").select(F.explode(turned).alias("e")).select("e.u", "e.v").where("u != v").distinct(), "small-star")
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
