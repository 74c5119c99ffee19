"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.session import durable


def stored(df: DataFrame) -> DataFrame:
    """A stored table for what is far smaller than the documents: an eighth of the shuffle's partitions, 8 at least.

    Every file costs its writer a process (the local file system sets its mode by one), so small tables get few.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(df.coalesce(max(8, partitions // 8)))


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``root``) of every node that is in a link (``a``, ``b``); the root is the smallest node reachable.

    Each round every node hands its neighbours to the smallest of them, first the larger ones, then the smaller ones.
    Rounds end when the links no longer change; they are stars around the roots then.  A round's links are a stored
    table, so a lost executor repeats one round at most, and no neighbourhood is gathered in one place.  Links with a
    null end and links from a node to itself say nothing.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, mark = stored(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(least, "a")
        small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
