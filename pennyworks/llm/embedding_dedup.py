"""Near-duplicate embeddings: spherical k-means cells, cosine blocks within cells, components of links.

Unit vectors are assigned to the centroid of largest cosine. A vector also visits each cell of a lower
number whose bisecting plane lies within the largest distance that two linked vectors can have, so no
link between cells is lost and each is found once. Where there are many vectors, every cell is parted again by
centroids of its own under the same rule, so that the number of cells grows with the rows. A cell's vectors at home and its guests are cut into blocks of
bounded size; blocks whose vectors may meet there are multiplied, tile by tile, and guests of the same level never are. Tiles return counts and a spanning forest, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pennyworks.llm.common import by_size, materialize
from pennyworks.llm.components import connected_components

COSINE = 0.93
#: Centroids are fitted on at most so many vectors a cell, and so many for the first level, taken in the order of a hash of the vector.
SAMPLE_ROWS, SAMPLE_A_CELL = 20_000, 16
#: Vectors of a cell, of a block (fewer if these are longer than BLOCK_BYTES), and of a side of a matrix product.
CELL_ROWS, BLOCK_ROWS, BLOCK_BYTES, TILE = 16_384, 8_192, 4 << 20, 2_048
#: Cells of the first level, and bytes of all centroids, which are broadcast.
TOP_CELLS, CENTROID_BYTES = 256, 32 << 20


def spherical_kmeans(unit: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids; starts from evenly spaced rows, and an emptied cell keeps its centroid."""
    centroids = unit[np.linspace(0, len(unit) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = (unit @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, unit)
        norms = np.linalg.norm(sums, axis=1)
        centroids[norms > 1e-9] = sums[norms > 1e-9] / norms[norms > 1e-9, None]
    if not np.isfinite(centroids).all():
        raise ValueError("a centroid is not finite")
    return centroids


def _unit(rows: list) -> np.ndarray:
    """Unit vectors; the largest component is taken out first, so that no norm overflows or vanishes."""
    x = np.array(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _visits(unit: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, guest) of every row's home among the centroids c and of the cells of a lower number that it visits."""
    sims = unit @ c.T
    home = sims.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (c[home] @ c.T)))
    visits = sims[np.arange(len(unit)), home][:, None] - sims <= reach * apart + 1e-12
    visits &= np.arange(len(c))[None] <= home[:, None]
    row, cell = np.nonzero(visits)
    return row, cell, cell != home[row]


@dataclass(frozen=True)
class Cells:
    """Centroids of the first level, and those that part each of its cells (one does not part it)."""

    top: np.ndarray
    inner: dict[int, np.ndarray]

    def assign(self, unit: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, guest): bit 0 of guest for a visit on the first level, bit 1 on the second. Two rows are compared in
        a cell if they share no bit; those that do meet elsewhere."""
        row, top, guest = _visits(unit, self.top, reach)
        cells = top.astype(np.int64) << 32
        parts = []
        for t in np.unique(top):
            at = np.flatnonzero(top == t)
            if t not in self.inner:
                parts.append((row[at], cells[at], guest[at].astype(np.int8)))
                continue
            r, cell, g = _visits(unit[row[at]], self.inner[t], reach)
            parts.append((row[at][r], cells[at][r] + cell, guest[at][r] + 2 * g.astype(np.int8)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _inner(nodes: DataFrame, dim: int, top: np.ndarray, k: int, rows: int) -> dict[int, np.ndarray]:
    """k centroids for each first-level cell, each fitted in a task of its own on its share of a sample of the vectors."""
    share = min(1.0, SAMPLE_A_CELL * k * len(top) / max(1, rows))
    sample = nodes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column(0).to_pylist())
            cell = pa.array((unit @ top.T).argmax(axis=1), pa.int32())
            yield pa.RecordBatch.from_arrays([cell, pa.array([x.tobytes() for x in unit], pa.binary())], names=["cell", "unit"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = np.frombuffer(b"".join(sorted(pdf["unit"])), np.float64).reshape(len(pdf), -1)
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "c": [spherical_kmeans(unit, min(k, len(unit)), 6).tobytes()]})

    found = sample.select("embedding").mapInArrow(home, "cell int, unit binary").groupBy("cell").applyInPandas(fit, "cell int, c binary")
    return {r.cell: np.frombuffer(r.c, np.float64).reshape(-1, dim) for r in found.collect()}  # CENTROID_BYTES in all


def _centroids(nodes: DataFrame) -> dict[int, Cells]:
    """Cells by the number of components."""
    shape = nodes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("most"), F.sum("count").alias("rows")).collect()  # a row per dimension
    out = {}
    for dim, most, rows in shape:
        sample = nodes.where(F.col("dim") == dim).orderBy(F.xxhash64("node"), "node").limit(SAMPLE_ROWS).select("embedding").toArrow()
        unit = _unit(sample.column(0).to_pylist())
        k = math.ceil(most / CELL_ROWS)
        top = spherical_kmeans(unit, min(TOP_CELLS, len(unit), k))
        inner = min(math.ceil(k / len(top)), CENTROID_BYTES // (8 * dim * len(top)))
        out[dim] = Cells(top, _inner(nodes, dim, top, inner, rows) if inner > 1 else {})
    return out


def _assign(nodes: DataFrame, centroids: dict[int, Cells], cosine: float) -> DataFrame:
    """(label, dim, cell, guest, node, copies, unit): one row at home and one for every cell visited."""
    shared = nodes.sparkSession.sparkContext.broadcast(centroids)
    reach = math.sqrt(2 - 2 * cosine) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column(1).to_pylist(), dtype=np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                unit = _unit(batch.column(4).take(pa.array(at)).to_pylist())
                row, cell, guest = shared.value[int(dim)].assign(unit, reach)
                rows = batch.select([0, 1, 2, 3]).take(pa.array(at[row]))
                columns = [*rows.columns, pa.array(cell, pa.int64()), pa.array(guest, pa.int8()), pa.array([unit[k].tobytes() for k in row], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "dim", "node", "copies", "cell", "guest", "unit"])

    return nodes.select("label", "dim", "node", "copies", "embedding").mapInArrow(run, "label string, dim int, node long, copies long, cell long, guest byte, unit binary")


#: By bits of guest, the bits of those that a row meets in a cell.
MEETS = {0: (0, 1, 2, 3), 1: (0, 2), 2: (0, 1), 3: (0,)}


def _tile(left: tuple, right: tuple, cosine: float, same: bool) -> pd.DataFrame | None:
    """Links between two sides (unit vectors, these in single precision, nodes, copies) of at most TILE rows; `same` says that they are one.

    Single precision leaves out what is surely too far apart, and only rows and columns with a pair that is not are multiplied in double precision.
    """
    slack = 1e-6 + 2.0**-22 * left[0].shape[1]
    near = left[1] @ right[1].T >= np.float32(cosine - slack)
    r, c = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(r):
        return None
    (a, m), (b, n) = ((side[2][at], side[3][at].astype(np.float64)) for side, at in ((left, r), (right, c)))
    linked = left[0][r] @ right[0][c].T >= cosine
    if same:
        linked &= a[:, None] != b[None]
    far, root, other = np.iinfo(np.int64).max, a, b
    while True:
        up = np.minimum(root, np.where(linked, other[None], far).min(axis=1))
        across = np.minimum(other, np.where(linked, up[:, None], far).min(axis=0))
        if (up == root).all() and (across == other).all():
            break
        root, other = up, across
    found = [(a, linked @ n, root)] if same else [(a, linked @ n, root), (b, m @ linked, other)]
    node, links, root = (np.concatenate(x) for x in zip(*found, strict=True))
    some = links > 0
    return pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "root": root[some]})


def _blocks(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between the rows of one block and another, or of a block with itself."""
        unit = np.frombuffer(b"".join(pdf["unit"]), np.float64).reshape(len(pdf), -1)
        rows = (unit, unit.astype(np.float32), pdf["node"].to_numpy(), pdf["copies"].to_numpy())
        first = pdf["first"].to_numpy()
        same = bool((pdf["i"].iloc[0] == pdf["j"].iloc[0]) and (pdf["of"].iloc[0] == pdf["to"].iloc[0]))
        sides = [[np.flatnonzero(which)[at : at + TILE] for at in range(0, int(which.sum()), TILE)] for which in (first, first if same else ~first)]
        side = lambda at: tuple(x[at] for x in rows)
        found = [_tile(side(a), side(b), cosine, same and k == n) for k, a in enumerate(sides[0]) for n, b in enumerate(sides[1]) if not same or k <= n]
        found = [x for x in found if x is not None]
        return pd.concat(found) if found else pd.DataFrame({c: np.array([], np.int64) for c in ("node", "links", "root")})

    return run


def _dealt(cells: DataFrame, block_rows: int) -> DataFrame:
    """cells by pairs of blocks: block i of the guests `of` and block j of the guests `to`, and whether a row is of the `first` one."""
    key = ["label", "dim", "cell"]
    rows = F.greatest(F.least(F.lit(block_rows), F.lit(BLOCK_BYTES) / (8 * F.max("dim"))), F.lit(1))
    blocks = lambda g: F.ceil(F.count_if(F.col("guest") == g) / rows).cast("int").alias(f"n{g}")
    parted = cells.join(cells.groupBy(*key).agg(*(blocks(g) for g in MEETS)), key)
    own = F.coalesce(*(F.when(F.col("guest") == g, F.col(f"n{g}")) for g in MEETS))
    parted = parted.withColumn("me", F.struct(F.col("guest").cast("int").alias("g"), F.pmod(F.xxhash64("node"), own).cast("int").alias("k")))

    def met(g: int) -> Column:
        block = lambda k: F.struct(F.lit(g).alias("g"), k.cast("int").alias("k"))
        meets = F.col("guest").isin([of for of, to in MEETS.items() if g in to]) & (F.col(f"n{g}") > 0)
        return F.when(meets, F.transform(F.sequence(F.lit(0), F.col(f"n{g}") - 1), block)).otherwise(F.array().cast("array<struct<g: int, k: int>>"))

    pairs = parted.withColumn("it", F.explode(F.concat(*(met(g) for g in MEETS)))).withColumn("a", F.least("me", "it")).withColumn("b", F.greatest("me", "it"))
    ends = [F.col("a.g").alias("of"), F.col("a.k").alias("i"), F.col("b.g").alias("to"), F.col("b.k").alias("j")]
    return pairs.select(*key, *ends, (F.col("me") == F.col("a")).alias("first"), "node", "copies", "unit")


def cluster(vectors: DataFrame, cosine: float = COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors(vec_id, embedding, label).

    Rows are compared only if their labels are equal and not null and their vectors have the same length.
    A vector that is null, empty, zero, or has null or non-finite components links with nothing, and so
    does a row without a vec_id (component_id null, kept false). Equal vectors are compared once for all
    and count as links of each other; repeated rows come back as often as they came, and a vec_id that stands for several
    vectors is one row for each; an empty table gives an empty result; other columns are not looked at. Vectors are told
    apart by 64-bit hashes.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    valid = rows.where(usable)
    nodes = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("dim", F.size("embedding")).withColumn("node", F.xxhash64("label", "embedding")), "distinct-vectors")

    cells = materialize(_assign(nodes, _centroids(nodes), cosine), "cells")
    dealt = _dealt(cells, block_rows)
    found = materialize(dealt.groupBy("label", "dim", "cell", "of", "i", "to", "j").applyInPandas(_blocks(cosine), "node long, links long, root long"), "block-links")

    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    members = materialize(nodes.select("node", "least").join(parts, "node"), "members")
    firsts = materialize(members.groupBy("component").agg(F.min("least").alias("first")), "first-members")
    placed = members.join(by_size(firsts), "component").select("node", "first")
    linked = nodes.join(counted, "node", "left").join(placed, "node", "left")
    linked = linked.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "least").alias("component"))
    joined = valid.join(linked, ["label", "embedding"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
