"""Connected components of an undirected graph given as links, by alternating large and small stars.

Every round works on written tables: the smallest neighbour of each node is a map-side combined
aggregate, and joins read both sides from files, so that adaptive execution can split a hub's links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortfolio.llm.storage import land


def _smallest(links: DataFrame) -> DataFrame:
    return land(links.groupBy("u").agg(F.min("v").alias("m")), "smallest")


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node among it and its neighbours."""
    both = land(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
    least = _smallest(both)
    return (both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = land(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"), "down")
    least = _smallest(down)
    joined = down.join(least, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node in the columns ``u`` and ``v`` of ``links``; component: smallest node reachable.

    Ends when a round changes nothing, which the links' count and sum show.
    """
    now = land(links.select("u", "v").where("u <> v").distinct(), "links")
    state = None
    while True:
        now = land(_small_star(land(_large_star(now), "large")), "small")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
