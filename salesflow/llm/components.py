"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.llm.common import drop, made, saved


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the node's smallest one."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and every neighbour below it (all are, in links with b < a) move to its smallest one."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
    return links.join(least, "a").select(moved).filter("a != b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none."""
    ends = F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"))))
    nodes = links.select(ends).groupBy("node").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("links"))
    return not nodes.filter("up > 0 AND links > 1").agg(F.count(F.lit(1))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of links (a, b) reaches.

    Each round writes its links to the shared folder, so a lost executor costs one round at most; those of the round
    before it are deleted.
    Nodes' minima are combined in each task before the shuffle and large stars meet them in a join
    that Spark can split, so a hot node does not land in one task.
    """
    now, tables = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), []
    while True:
        before = tables
        with made() as tables:
            now = saved(_small_star(_large_star(now)))
        drop(links.sparkSession, before)
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
