"""Connected components of a link table, by alternating large and small stars.

Each round rewrites the links so that nodes point at ever smaller nodes; the number
of rounds grows with the logarithm of the longest chain. A node with very many links
is only ever the key of partial minima and of a join with one row on its other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import save


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where("b < a")
    low = near.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    moved = near.join(low, "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = moved.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    Loops, repeated and reversed links change nothing; null ends are ignored; no links give no rows.
    """
    now = save(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct())
    state = None
    while True:
        now = save(_star(_star(now, True), False))
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state or found[0] == 0:
            break
        state = tuple(found)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
