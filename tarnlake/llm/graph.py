"""Connected components of links between nodes, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.store import dropped, saved


#: Links of a task: few links make few tasks, whatever the number of shuffle partitions.
ROWS = 100_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its component's smallest node) for every node that has a link to another one.

    Each half-round joins the links to the smallest neighbour of one end, an aggregate with one row for each node; so a
    hub's links are never gathered. Links are written to the shared folder between rounds and never come to the driver,
    which sees one checksum a round. Repeated links and links to oneself change nothing; no links give no rows. The
    result is a saved table, which the caller may drop.
    """
    edges = saved(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    width = edges.count() // ROWS + 1  # star steps don't add links, so the first count bounds all rounds
    seen = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.where("u <> v").distinct(), width)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        new = saved(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), width)
        dropped(edges, large)
        edges = new
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            break
        seen = mark
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out = saved(ends, width)
    dropped(edges)
    return out
