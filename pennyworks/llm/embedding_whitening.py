"""Whitening of embeddings from an exact integer scatter matrix.

Entries are scaled to integers. Of what is left after a shift, sums and cross-products are gathered as integers of any size: a task
multiplies short digits of them, so small that floating point is exact, and sends the totals in digits of 40 bits, which Spark sums. The
scatter n * X'X - S S' then has no rounding at all; only it is converted to floating point and decomposed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Bits of a digit in products, and rows that are multiplied at once: 2 * 20 + 12 bits are exact in double precision.
DIGIT, ROWS = 20, 1 << 12
#: Bits of a digit in Spark's sums: 2**23 tasks stay within a long.
SENT = 40
_LARGEST = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """n vectors, their sums less the shift, and per component the direction over the root of its eigenvalue."""

    n: int
    sums: list[int]
    directions: np.ndarray
    explained: list[float]
    identity_error: float


def integers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): the vectors of `dims` finite entries as floor(SCALE * c) + OFFSET. Beyond 2**62 an integer stays there."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(rows)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dims)  # a null entry comes as not a number
    clean = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * x[clean])
    large = np.abs(x) >= _LARGEST
    whole = np.where(large, 0, x).astype(np.int64)
    return rows[clean], np.where(large, np.where(x < 0, -_LARGEST, _LARGEST), whole) + OFFSET


def _digits(y: np.ndarray) -> list[np.ndarray]:
    """y as digits of DIGIT bits, the lowest first, as doubles; only the last ones are negative."""
    found = []
    while True:
        if np.abs(y).max(initial=0) < 1 << DIGIT:
            return [*found, y.astype(np.float64)]
        found.append((y & (1 << DIGIT) - 1).astype(np.float64))
        y = y >> DIGIT


def products(y: np.ndarray) -> np.ndarray:
    """y'y as Python integers."""
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for at in range(0, len(y), ROWS):
        digits = _digits(y[at : at + ROWS])
        for a, left in enumerate(digits):
            for b, right in enumerate(digits):
                total += (left.T @ right).astype(np.int64).astype(object) * (1 << DIGIT * (a + b))
    return total


def _gathered(vectors: DataFrame, dims: int, shift: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sums and products of what is left of all vectors after the shift. What reaches the driver grows with dims squared, not with the rows."""
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, scatter = 0, np.zeros(dims, dtype=object), np.zeros((dims, dims), dtype=object)
        for batch in batches:
            _, x = integers(batch.column(0), dims)
            y = x - shift
            n, scatter = n + len(y), scatter + products(y)
            for k, digit in enumerate(_digits(y)):
                sums = sums + np.add.reduceat(digit, np.arange(0, len(digit), ROWS)).astype(np.int64).astype(object).sum(axis=0) * (1 << DIGIT * k) if len(digit) else sums
        cells, places, values = [], [], []
        for cell, value in enumerate([n, *sums, *scatter[upper]]):
            place = 0
            while value not in (0, -1) or not place:
                cells.append(cell)
                places.append(place)
                values.append(int(value) & (1 << SENT) - 1)
                value, place = int(value) >> SENT, place + 1
            if value:
                cells.append(cell)
                places.append(place)
                values.append(-1)
        for at in range(0, len(cells), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(cells[part], pa.int64()), pa.array(places[part], pa.int32()), pa.array(values[part], pa.int64())], names=["cell", "place", "value"])

    sent = vectors.mapInArrow(run, "cell long, place int, value long").groupBy("cell", "place").agg(F.sum("value").alias("value"))
    flat = [0] * (1 + dims + len(upper[0]))
    for r in sent.collect():
        flat[r.cell] += r.value << SENT * r.place
    scatter = np.zeros((dims, dims), dtype=object)
    scatter[upper] = flat[1 + dims :]
    return flat[0], np.array(flat[1 : 1 + dims], dtype=object), np.triu(scatter) + np.triu(scatter, 1).T


def decompose(n: int, sums: np.ndarray, scatter: np.ndarray, components: int = COMPONENTS) -> Whitening:
    """Leading components of the covariance with divisor n. Directions without any variance, to double precision, are none."""
    exact = n * scatter - np.multiply.outer(sums, sums)
    covariance = np.array([[t / (n * n) for t in row] for row in exact], dtype=np.float64)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = int((values[:components] > len(values) * np.finfo(float).eps * max(values[0], 0)).sum()) if len(values) else 0
    directions = vectors[:, :kept] / np.sqrt(values[:kept])
    trace = sum(np.diag(exact)) / (n * n)
    error = np.abs(directions.T @ covariance @ directions - np.eye(kept)).max(initial=0)
    return Whitening(n, [int(s) for s in sums], directions, [float(v / trace) for v in values[:kept]], float(error))


def fit(embeddings: DataFrame, shift: int = OFFSET, components: int = COMPONENTS) -> tuple[int, Whitening | None]:
    """Dimensions and whitening of embeddings(embedding); none if no vector is left."""
    vectors = embeddings.select("embedding")
    lengths = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("dims")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("dims")).first()
    if first is None or not first.dims:
        return 0, None
    n, sums, scatter = _gathered(vectors, first.dims, shift)
    return first.dims, decompose(n, sums, scatter, components) if n else None


def _squares(d: np.ndarray) -> list[int]:
    """Sums of squares of each row, exact."""
    if d.dtype == object or d.shape[1] > 256:
        return [sum(v * v for v in row) for row in d.tolist()]
    high, low = d >> 26, d & (1 << 26) - 1
    parts = zip((high * high).sum(axis=1).tolist(), (high * low).sum(axis=1).tolist(), (low * low).sum(axis=1).tolist(), strict=True)
    return [(a << 52) + (b << 27) + c for a, b, c in parts]


def whiten(embeddings: DataFrame, shift: int = OFFSET, components: int = COMPONENTS) -> DataFrame:
    """A row per vector of embeddings(vec_id, embedding) and component: n, deviation decimal(38,0), whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are left out, and so are those of another length than most (of equally frequent
    lengths the larger counts). A null vec_id passes through, repeated rows count and come back as often as they came, other
    columns are not looked at. Without vectors, or without variance, the result is empty. Components without variance are left out; of
    equal eigenvalues any order is as good. A deviation of more than 38 digits is null. The result does not depend on the shift.
    """
    dims, model = fit(embeddings, shift, components)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    names = [c.split()[0] for c in schema.split(", ")]
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = len(model.explained) if model else 0
        for batch in batches:
            if not kept:
                continue
            at, x = integers(batch.column(1), dims)
            y, n = x - shift, model.n
            reach = n * int(np.abs(y).max(initial=0)) + max(map(abs, model.sums))
            if reach < 1 << 53:
                d = n * y - np.array(model.sums, np.int64)
                off = d / n
            else:
                d = n * y.astype(object) - np.array(model.sums, dtype=object)
                off = np.array([[v / n for v in row] for row in d.tolist()]).reshape(d.shape)
            deviation = [Decimal(v) if v < 10**38 else None for v in _squares(d)]
            again = np.repeat(np.arange(len(at)), kept)
            m = len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)).take(pa.array(again)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, n, np.int64)),
                    pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(again)), pa.array((off @ model.directions).reshape(-1)),
                    pa.array(np.tile(np.array(model.explained), m)), pa.array(np.full(m * kept, model.identity_error)),
                ],
                names=names,
            )

    return rows.mapInArrow(run, schema)
