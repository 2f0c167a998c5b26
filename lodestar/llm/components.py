"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestar.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """Rows (node, component) of every node in a link (a, b); component is its least reachable node.

    Each round hangs the larger neighbours of a node, then the smaller ones, under
    its least neighbour, until no edge changes; every round is a written table.
    """
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    seen, number = None, 0
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")  # not distinct yet: least neighbours are the same
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        number += 1
        sums = Observation()  # taken while the round is written, so that no further job reads it
        edges = scratch.keep(small.observe(sums, F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")), f"{name}-{number}")
        scratch.drop(f"{name}-{number - 1}")
        if sums.get == seen:
            break
        seen = sums.get
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
