"""A store of transactions that follows a folder of ledger text: new files rebuild the folders that they are in, and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pennyworks.sources import ledger_text, store

#: Files of one batch, which bounds the names of folders that a batch touches.
FILES = 1000
#: Fixed by Spark: what its reader of whole files gives, of which only the path is read.
NAMES = "path string, modificationTime timestamp, length long, content binary"


def folder_txns(spark: SparkSession, source: str, folders: list[str]) -> DataFrame:
    """Transactions(account, folder, ...) of some folders `folder=NAME` of ledger text; only their files are listed and read."""
    lines = ledger_text.read_lines(spark, [f"{source}/folder={name}" for name in folders])
    txns = ledger_text.parse_lines(lines, in_order=True)
    account = F.coalesce(F.get("postings", F.lit(0))["account"], F.lit("none"))
    return txns.withColumn("account", account).withColumn("folder", F.regexp_extract("file", "/folder=([^/]+)/", 1))


def follow(spark: SparkSession, source: str, path: str, checkpoint: str, files: int = FILES) -> int:
    """Brings the store at path up to date with the folders below source, and tells how many batches changed it.

    The stream remembers which files it has seen; of a batch only the names are read. A touched folder is read again as a whole, so a batch that
    is replayed, or files that come in another order, leave the same store, and one without changes writes nothing. Files without a byte
    are not seen.
    """
    changed = []

    def rebuild(batch: DataFrame, _: int) -> None:
        names = [r.folder for r in batch.select(F.regexp_extract("path", "/folder=([^/]+)/", 1).alias("folder")).where("folder <> ''").distinct().collect()]
        if names:
            touched = batch.sparkSession.createDataFrame([(n,) for n in names], "folder string")
            changed.append(store.update(batch.sparkSession, folder_txns(batch.sparkSession, source, sorted(names)), path, touched))

    stream = spark.readStream.format("binaryFile").schema(NAMES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).load(source).select("path")
    query = stream.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(changed)
