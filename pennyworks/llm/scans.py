"""Prefix scans over rows that are sorted by Spark: each task scans its range with numpy, and what runs over its end is carried on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pennyworks.llm.common import materialize

_WRAP = (1 << 64) - 1


def _local(base: int):
    """Ordinals and polynomial sums within a task. The rows held back at the end tell which one is the task's last."""
    up, down = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, total, held = None, 0, np.uint64(0), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield pa.RecordBatch.from_arrays([*held, pa.array(np.zeros(len(held[0]), bool))], names=names)
            names = [*batch.schema.names, "d", "h", "_last"]
            keys, values = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            n = len(keys)
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            which = np.cumsum(np.bincount(first, minlength=n)) - 1
            place = np.arange(n) - first[which] + 1
            sums = np.cumsum(values * np.power(down, place.astype(np.uint64)))
            before = np.r_[np.uint64(0), sums][first][which]
            h, d = (sums - before) * np.power(up, place.astype(np.uint64)), place
            if key == keys[0]:
                own = which == 0
                h = h + np.where(own, total * np.power(up, place.astype(np.uint64)), np.uint64(0))
                d = d + np.where(own, count, 0)
            key, count, total = keys[-1], int(d[-1]), h[-1]
            held = [*batch.columns, pa.array(d.astype(np.int64)), pa.array(h.view(np.int64))]
        if held is not None:
            last = np.zeros(len(held[0]), bool)
            last[-1] = True
            yield pa.RecordBatch.from_arrays([*held, pa.array(last)], names=names)

    return run


def prefix_scan(rows: DataFrame, key: str, order: list[str], value: str, name: str, base: int = 1) -> DataFrame:
    """rows with d, their place from 1 among those of their key (long) by `order`, h = h before * base + value modulo 2**64, and that h before, `p`.

    base is odd; with 1, h is a running sum. Neither key nor value is null. Sorted ranges of rows go to tasks, so a key with very many rows is
    spread over many; of each task one row, its last, tells the driver what the next one starts from. Equal rows by key and order stand
    in any order. An empty table gives an empty one.
    """
    others = [c for c in rows.columns if c not in (key, value)]
    ranged = rows.select(key, value, *others).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    schema = ranged.select("*", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("h"), F.lit(True).alias("_last")).schema
    local = materialize(ranged.mapInArrow(_local(base), schema).withColumn("_part", F.spark_partition_id()), name)
    carried: dict[int, tuple[int, int, int]] = {}
    now: tuple[int, int, int] | None = None
    for part, k, d, h in sorted(tuple(r) for r in local.where("_last").select("_part", key, "d", "h").collect()):  # a row a task
        if now:
            carried[part] = now
        now = (k, d + now[1], h + now[2] * pow(base, d, 1 << 64)) if now and now[0] == k else (k, d, h)
        now = (*now[:2], now[2] & _WRAP)
    up, down = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
    columns = [*rows.columns, "d", "h", "p"]

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, h, t, keys, parts = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("d", "h", value, key, "_part"))
            d, h = d.copy(), h.view(np.uint64).copy()
            for part in set(parts.tolist()) & carried.keys():
                k, count, total = carried[part]
                own = (parts == part) & (keys == k)
                h[own] += np.uint64(total) * np.power(up, d[own].astype(np.uint64))
                d[own] += count
            p = (h - t.view(np.uint64)) * down
            made = {"d": pa.array(d), "h": pa.array(h.view(np.int64)), "p": pa.array(p.view(np.int64))}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(batch.schema.get_field_index(c)) for c in columns], names=columns)

    return local.mapInArrow(carry, rows.select("*", *(F.lit(0).cast("long").alias(c) for c in ("d", "h", "p"))).schema)
