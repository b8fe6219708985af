"""Connected components of a graph given as links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carequeue.llm.shared import checkpointed


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor("u"), F.bit_xor("v")).first())


def connected_components(links: DataFrame) -> DataFrame:
    """From links (u, v) of bigints to (node, component): each linked node and the smallest node it reaches.

    Rounds until nothing changes, their number logarithmic in the longest chain; each round is written to
    the checkpoint folder, and only a count and a checksum come to the driver. The smallest node of a
    component is returned with itself. Nulls and links of a node to itself are left out.
    """
    links = checkpointed(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = _signature(links)
    while before[0]:
        links = checkpointed(_small_star(_large_star(links).distinct()).distinct())
        after = _signature(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
