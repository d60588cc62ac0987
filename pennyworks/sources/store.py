"""Transactions kept as Parquet by account and folder: only changed folders are written, only those in scope are read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pennyworks.functions.patterns import in_scope
from pennyworks.sources.scratch import written

KEY = ["account", "folder"]


def digests(txns: DataFrame) -> DataFrame:
    """account, folder, n and digest; the digest does not depend on the order of rows."""
    own = [c for c in sorted(txns.columns) if c not in KEY]
    return txns.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*own).cast("decimal(38,0)")).alias("digest"))


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/digests")
    except AnalysisException:  # nothing stored yet
        return None


def _live(versions: DataFrame) -> DataFrame:
    """The folders of the last version, whose number is one row; a row without transactions only marks a version."""
    last = versions.agg(F.max("version").alias("version"))
    return versions.join(F.broadcast(last), "version").where("n > 0")


def _same(left: str, right: str, *columns: str) -> Column:
    found = F.lit(True)
    for c in columns:
        found = found & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return found


def update(spark: SparkSession, txns: DataFrame, path: str, touched: DataFrame | None = None) -> bool:
    """Makes the store at path hold txns(account, folder, ...). Folders with the same digest stay as they are; tells whether any did not.

    With touched(folder), txns are all of these folders only, and the others stay. The list of live folders is written last, as a new version: a run
    that is lost before leaves the old list, and running again mends it; a run that changes nothing writes nothing. Folders that are no longer in
    the list are not read any more, see prune(). A null account or folder is one of its own. One writer at a time.
    """
    null = F.lit(None).cast("string")
    mark = spark.range(1).select(*(null.alias(c) for c in KEY), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("digest"))
    txns = written(txns, "txns")  # read by the digests and by what is stored, and parsed once
    versions, now = _versions(spark, path), digests(txns)
    if versions is None:
        todo, now = txns, now.unionByName(mark).withColumn("version", F.lit(1))
    else:
        old = _live(versions).select(*KEY, "n", "digest")
        if touched is not None:
            others = old.alias("a").join(F.broadcast(touched.select("folder").distinct()).alias("b"), _same("a", "b", "folder"), "left_anti")
            now = now.unionByName(others.select(*KEY, "n", "digest"))
        now = written(now, "digests")
        kept = _same("a", "b", *KEY, "n", "digest")
        changed = now.alias("a").join(old.alias("b"), kept, "left_anti").select(*KEY)
        if not changed.take(1) and not old.alias("a").join(now.alias("b"), _same("a", "b", *KEY), "left_anti").take(1):
            return False
        todo = txns.alias("a").join(changed.alias("b"), _same("a", "b", *KEY), "left_semi")
        now = now.unionByName(mark).join(F.broadcast(versions.agg((F.max("version") + 1).alias("version"))))
    # A large folder is written by several tasks, as one does not hold it.
    todo.hint("rebalance", *KEY).write.partitionBy(*KEY).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/txns")
    now.write.mode("append").parquet(f"{path}/digests")
    return True


def prune(spark: SparkSession, path: str) -> int:
    """Deletes the files of folders that are not live any more, and tells how many there were. What is collected are names of dropped folders."""
    versions = spark.read.parquet(f"{path}/digests")
    dead = versions.where("n > 0").select(*KEY).distinct().alias("a").join(_live(versions).alias("b"), _same("a", "b", *KEY), "left_anti")
    held = spark.read.schema("account string, folder string").parquet(f"{path}/txns").withColumn("at", F.regexp_extract("_metadata.file_path", "^(.*)/[^/]+$", 1))
    gone = held.alias("a").join(dead.alias("b"), _same("a", "b", *KEY), "left_semi").select("at").distinct().collect()
    for r in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(r["at"]))
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(gone)


def load(spark: SparkSession, path: str, scope: str | None = None) -> DataFrame:
    """All live transactions, or those of accounts at or below `scope`; both keys are partition columns, so other folders are not read."""
    stored = spark.read.parquet(f"{path}/txns").schema
    schema = StructType([StructField(f.name, StringType()) if f.name in KEY else f for f in stored])  # else a folder 2024 would come back as a number
    rows, live = spark.read.schema(schema).parquet(f"{path}/txns"), _live(spark.read.parquet(f"{path}/digests")).select(*KEY)
    if scope:
        rows, live = rows.where(in_scope(F.col("account"), scope)), live.where(in_scope(F.col("account"), scope))
    return rows.alias("a").join(live.alias("b"), _same("a", "b", *KEY), "left_semi")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """account, folder and number of transactions, from the list alone."""
    return _live(spark.read.parquet(f"{path}/digests")).select(*KEY, "n")
