"""Connected components of a link table, by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefuse.llm.common import written


def _toward_smallest(links: DataFrame, both: bool) -> DataFrame:
    """Relink each node's neighbours to the smallest of them (and itself).

    `links` holds (u, v) with u > v. With `both`, larger neighbours are relinked, else smaller ones.
    The smallest neighbours are written first, so that the join reads two plain tables and the
    runtime can split a node with very many links.
    """
    seen = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both \
        else links
    low = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    low = written(low, "smallest")
    moved = seen.join(low, "u")
    if both:
        return moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        low.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """`node, component`: the smallest node reachable, for every node that has a link.

    Takes two columns of long node ids in any order, repeats and self-links included. Each round
    is a few aggregations and joins on tables cut off from their lineage; the number of rounds
    grows with the logarithm of the longest chain. Only two numbers a round reach the driver.
    """
    a, b = links.columns
    links = links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    watched = {"n": F.count(F.lit(1)), "sum": F.bit_xor(F.xxhash64("u", "v"))}
    links, before = written(links, "links", **watched)
    while before["n"]:
        links = _toward_smallest(links, both=True).where("u > v").distinct()
        links = _toward_smallest(written(links, "stars"), both=False).where("u > v").distinct()
        links, now = written(links, "links", **watched)
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
