"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but these six ASCII white-space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
ASCII_SPACES = " \t\n\x0b\x0c\r"

#: Rows that a task holds as Python objects at a time, and bytes of rows that Spark sends to a task's Python at once.
ROWS_AT_ONCE, BATCH_BYTES = 256, 4 << 20
_MAX_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_own_dirs: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where Spark runs in a single process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dirs:
        _own_dirs.append(tempfile.mkdtemp(prefix="spark-pennyworks-"))
        atexit.register(shutil.rmtree, _own_dirs[0], ignore_errors=True)
    return "file://" + os.path.abspath(_own_dirs[0])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: the table outlives any executor, so what follows never recomputes df.
    """
    spark = df.sparkSession
    path = f"{_shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (out, path)
    return out


_written: dict[int, tuple[DataFrame, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing will read again: what was made of them has been written itself."""
    for t in tables:
        _, path = _written.pop(id(t), (None, None))
        if path:
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(df: DataFrame) -> DataFrame:
    """df, after its session is told to send rows to Python by bytes, not by 10,000 whatever their length; a limit that the user set stays.

    A batch is held at once by Spark and by Python, beside the heap, in each task; the rows and their order are the same."""
    conf = df.sparkSession.conf
    if _MAX_BATCH not in conf.getAll:
        conf.set(_MAX_BATCH, str(BATCH_BYTES))
    return df


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some rows of a batch at a time, so that a task's Python objects do not grow with its batches; what a task leaves unused goes back."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)
    pa.default_memory_pool().release_unused()


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: fold 0 is held out from every fit."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Largest table of ids that is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def by_size(ids: DataFrame) -> DataFrame:
    """ids, marked for broadcast if it has at most BROADCAST_ROWS rows. Meant for narrow, written tables."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not among ids; rows without a doc_id stay."""
    return docs.join(by_size(ids), "doc_id", "left_anti").select(*docs.columns)
