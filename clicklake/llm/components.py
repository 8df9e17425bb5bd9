"""Connected components of links, by stars that grow and shrink until all are one deep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it can reach, for each node of links ``a``, ``b``.

    Each round ties the larger neighbours of a node to the smallest of its neighbourhood,
    and then the smaller ones with itself; the rounds are about the logarithm of the
    longest way. Links stay as many as there are nodes or fewer; only their minima are
    gathered, after each task has taken its own. A node linked with itself alone is its root.
    """
    links = stored(links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL"), "links")
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "links-0")
    rounds = 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.filter("u <> v")
        large = stored(large, f"links-large-{rounds}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = stored(small, f"links-{rounds + 1}")
        rounds += 1
        same = small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty()
        edges = small
        if same:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
