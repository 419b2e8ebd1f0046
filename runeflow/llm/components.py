"""Connected components of a graph given as a table of links, by alternating large and small stars.

Each round is two grouped minima and two joins; the minima are written out before they are joined back, so that both
sides of the join are plain shuffles and a hub (a document with thousands of links) is split by the engine.  Links are
never gathered for a node: a round moves one row per link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v), u > v.  Large star: larger neighbours of u go to u's smallest; small star: smaller ones and u itself."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    at = both.join(least, "u")
    if large:
        out = at.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = at.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).groupBy("u", "v").agg(F.lit(1).alias("n")).select("u", "v")


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node that has a link to another; the component is its smallest node.

    ``links``: two long columns, in either order and with repeats; nulls and links of a node to itself say nothing.
    """
    a, b = links.columns
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
    e = materialize(e.groupBy("u", "v").agg(F.lit(1).alias("n")).select("u", "v"), "links")
    for _ in range(max_rounds):
        # done when each node hangs on one smallest node that itself hangs on nothing
        many = e.groupBy("u").agg(F.count("v").alias("n")).where("n > 1").limit(1).count()
        if not many and not e.join(e.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            break
        e = materialize(_star(materialize(_star(e, True), "large"), False), "small")
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
