"""Which nodes of a graph hang together, by Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pennyworks.sources.scratch import written


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of edges(a, b): root is the least node that can be reached; a root itself is not listed.

    Each round hangs a node's neighbours on the least among them, first the greater ones, then the smaller ones, until all edges lead to roots. A round's
    edges are a table in the shared folder, so its lineage ends there, and only counts come to the driver. Edges from a node to itself say nothing.
    Partial minima are taken before each shuffle, and the joins that follow can be split where a node has very many neighbours.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # An edge leads from a greater node to a smaller one. Done if no end of an edge is the start of another one, and none starts twice.
        starts = now.groupBy("a").agg(F.count("*").alias("n"))
        if starts.where("n > 1").isEmpty() and now.select(F.col("b").alias("a")).join(starts, "a", "left_semi").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = written(small.distinct(), "edges")
