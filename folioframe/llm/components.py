"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


#: A node is a hub if it has more than one in so many links: there are some thousands at most.
HUB = 1000


def _star(links: DataFrame, large: bool, total: int) -> DataFrame:
    """Links each node's neighbours (the larger ones, or the smaller ones and itself) to its least neighbour; `total` is about the number of
    links. Hubs, a few by their definition, are broadcast, and their links are spread by the other end, so that no task gets all links of one.
    A large step may repeat links, never beyond their number; the small step that follows makes them distinct."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links  # a > b always holds: b are the smaller neighbours of a
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    least = written(least.select("a", F.least("a", "m").alias("m"), (F.col("n") * HUB > total).alias("hub")), "cc-least")
    hubs = F.broadcast(least.filter("hub").select("a", F.col("m").alias("hm")))
    # a hub's links carry a stand-in key; what it meets, if anything, gives way to the hub's own least neighbour
    spread = both.join(hubs, "a", "left").withColumn("k", F.when(F.col("hm").isNull(), F.col("a")).otherwise(F.xxhash64("b")))
    joined = spread.join(least.select(F.col("a").alias("k"), "m"), "k", "left").withColumn("m", F.coalesce("hm", "m"))
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    out = out.filter(F.col("a") > F.col("b"))
    return written(out if large else out.distinct(), "cc")


def _state(links: DataFrame) -> tuple[int, int]:
    """The number of links, and of nodes that have several smaller neighbours or both smaller and larger ones."""
    ends = links.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    total, inner = nodes.agg(F.sum("up"), F.count_if(F.expr("up > 1 OR up = 1 AND down = 1"))).first()
    return total or 0, inner


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of links(a long, b long), the least node it is connected with.

    Each step is written to the shared folder, so lineage stays short and a lost executor costs one
    step. A node's neighbours are never gathered: its least one is a min with partial aggregation, and
    each link meets it by a join, for hubs a broadcast one. It ends when all links are stars around their
    least nodes. Self-links and repeated links do no harm; links with a null end are ignored; no links give no rows.
    """
    now = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    while True:
        total, inner = _state(now)
        if not inner:
            break
        now = _star(_star(now, True, total), False, total)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
