"""Connected components of links, by alternating large-star and small-star rounds over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hook neighbours to the least node around u.

    The minimum is a map-side combined aggregate and the hooks are an equi-join on u, whose skewed side AQE splits, so
    no node's neighbours meet in one task or one row.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hooked = both.join(least, "u")
    if large:
        new = hooked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        new = hooked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return new.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b): longs, or structs of one type; component is the least node reachable.

    Nodes without a link don't appear; self-links, repeated links and links with a null end are ignored.
    Each round is cut with a checkpoint; the driver sees one number a round.
    """
    now = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == last:
            break
        now = cut(_star(_star(now, True), False))
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
