"""Connected components of links too many for one machine: large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(links: DataFrame, key: str) -> DataFrame:
    """(u, v, m): the links with the least end that any link of ``key`` names.

    The minima are written first: the join then has two plain shuffles, whose hot keys Spark can split.
    """
    least = stored(links.groupBy(key).agg(F.least(F.min("v"), F.min("u")).alias("m")), "least")
    return links.join(least, key)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # all links go from the larger to the smaller end here
    star = _star(links, "u")
    moved = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected (u, v) links; a component is its least node.

    Every round is written to the shared folder.  Rounds end when the links, which then are stars
    around the components, no longer change.
    """
    now, before = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links"), None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not mark.n or mark == before:
            break
        before, now = mark, stored(_small_star(stored(_large_star(now), "large")), "links")
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
