"""Connected components of an undirected graph, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pennyworks.llm.common import materialize


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one task as a forest: every node once, next to the least node that it reaches in this task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        columns = [pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for each node that occurs in edges(a long, b long); component is its least node.

    Every round hangs each node's neighbours on its least neighbour and is written to the shared folder.
    Rounds grow with the logarithm of the graph's diameter. Self-loops and repeated edges are ignored.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    now = materialize(edges.mapInArrow(_local_forest, "a long, b long"), name)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), name)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
