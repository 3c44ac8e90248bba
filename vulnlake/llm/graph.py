"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import checkpointed


#: A node with more links than this, and than a `MOST_HUBS`th of all link ends, is a hub; so there are `MOST_HUBS` at most.
HUB_LINKS, MOST_HUBS = 50_000, 10_000


def told(both: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """Links (u, v) with the smallest node `m` around u. Links of hubs learn it from a broadcast table, of at most
    `MOST_HUBS` rows whatever the input, and stay where they are; the others are dealt by u."""
    hubs = least.filter(F.col("n") > max(HUB_LINKS, ends // MOST_HUBS)).select("u", "m")
    if hubs.isEmpty():
        return both.join(least.select("u", "m"), "u")
    return both.join(F.broadcast(hubs), "u").unionByName(both.join(F.broadcast(hubs), "u", "left_anti").join(least.select("u", "m"), "u"))


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Rows (node, root): the smallest node reachable from each node of the links; its own for a root.

    Each round links every neighbour of a node to the smallest one, first for the larger neighbours, then for the
    smaller; links become stars after about log(nodes) rounds. Minima are aggregated before they are shuffled. Links to
    itself are left out, repeated links count once, no links give no rows. Nothing but counts comes to the driver.
    """
    edges = checkpointed(
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter("u <> v").distinct()
    )
    count = edges.count()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        least = checkpointed(least.select("u", F.least("u", "m").alias("m"), "n"))
        large = told(both, least, 2 * count).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = checkpointed(small.select("e.u", "e.v").filter("u <> v").distinct())
        # a star forest stays as it is: the same number of links, none of them new
        before, count = count, after.count()
        if count == before and after.join(edges, ["u", "v"], "left_anti").isEmpty():
            roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        edges = after
