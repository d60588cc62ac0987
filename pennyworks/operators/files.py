"""Rows that several files hold, what two sides miss of each other, and appending only what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def winners(rows: DataFrame) -> DataFrame:
    """rows(folder, file, size, day, key): for each key of a folder, the file that keeps it, and in how many files it is.

    The file that covers the most days wins, then the largest, then the first by name. Copies within a file
    count once, so a key's group has one row a file.
    """
    span = F.datediff(F.max(F.to_date("day")), F.min(F.to_date("day")))
    files = rows.groupBy("folder", "file").agg(span.alias("days"), F.max("size").alias("size"))
    ranked = Window.partitionBy("folder", "key").orderBy(F.desc("days"), F.desc("size"), "file")
    held = rows.select("folder", "key", "file").distinct().join(files, ["folder", "file"]).withColumn("rank", F.row_number().over(ranked))
    best = F.max(F.when(F.col("rank") == 1, F.col("file")))
    return held.groupBy("folder", "key").agg(best.alias("file"), F.count("*").alias("files"))


def manifest_diff(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Keys that one side lacks, with the side that lacks them."""
    ours, theirs = local.select(key).distinct(), remote.select(key).distinct()
    missing_here = theirs.join(ours, key, "left_anti").select(key, F.lit("local").alias("missing"))
    return missing_here.unionByName(ours.join(theirs, key, "left_anti").select(key, F.lit("remote").alias("missing")))


def new_only(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key old does not hold, one for each key: the least by all columns."""
    fresh = new.join(old.select(key).distinct(), key, "left_anti")
    rest = [c for c in new.columns if c != key]
    return fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("row")).select(key, "row.*")


def deduplicated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, report) of rows(folder, file, size, day, key, ...): of a key that several files of a folder hold, only the winner's rows stay.

    The report has a row a folder and file: rows, those dropped, and whether nothing is left of it, so that it can be archived. What is kept has no
    doubles any more, so doing it again changes nothing. Rows without a key stay.
    """
    best = winners(rows.where("key is not null")).where("files > 1").select("folder", "key", F.col("file").alias("winner"))
    marked = rows.join(best, ["folder", "key"], "left").withColumn("dropped", F.coalesce(F.col("winner") != F.col("file"), F.lit(False)))
    gone = F.sum(F.col("dropped").cast("long"))
    report = marked.groupBy("folder", "file").agg(F.count("*").alias("rows"), gone.alias("dropped"), (gone == F.count("*")).alias("archived"))
    return marked.where("not dropped").select(*rows.columns), report
