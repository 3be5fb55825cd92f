"""Connected components of a link table by alternating large and small stars.

Each round is joins and minima over the links; nothing is gathered by node. Only nodes that move their
links, and nodes with several links to smaller ones, take part in a round's joins, each done once. Rounds end when every
node but the smallest of its component has one link, to a node that has none: the component's smallest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import cut

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (u, v of any ordered type); component is the smallest node.

    Repeated links and self links do no harm; no links give no rows.
    """
    e = cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        downwards = e.select(F.col("u").alias("node"), F.col("v").alias("other"), F.lit(1).alias("below"), F.lit(0).alias("above"))
        upwards = e.select(F.col("v").alias("node"), F.col("u").alias("other"), F.lit(0).alias("below"), F.lit(1).alias("above"))
        nodes = cut(downwards.union(upwards).groupBy("node").agg(F.min("other").alias("m"), F.sum("below").alias("below"), F.sum("above").alias("above")))
        if nodes.filter("below > 1 or (below > 0 and above > 0)").isEmpty():
            break
        moved = nodes.filter("above > 0 and m < node").select(F.col("node").alias("v"), "m")
        large = cut(e.join(moved, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        others = large.join(least.filter("n > 1").drop("n"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(others.union(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
