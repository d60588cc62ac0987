"""What folders inherit: the mapping of the nearest folder above, and the rules of all of them, the closest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(folder: Column, sep: str = ":") -> Column:
    """(path, depth) of a folder and of all above it; the root is an empty path of depth 0."""
    parts = F.split(folder, sep)
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), sep).alias("path"), k.alias("depth")))
    return F.when(folder.isNotNull(), up)


def _above(folders: DataFrame, sep: str) -> DataFrame:
    """Each folder once, with all above it: rows grow with the folders and their depth, not with what is in them."""
    return folders.select("folder").distinct().select("folder", F.explode(ancestors(F.col("folder"), sep)).alias("a")).select("folder", "a.path", "a.depth")


def nearest(folders: DataFrame, specs: DataFrame, sep: str = ":") -> DataFrame:
    """folder and the columns of specs(path, ...) of the nearest folder at or above it that has one; folders without any are left out. Of two specs of a path the least counts."""
    rest = [c for c in specs.columns if c != "path"]
    met = _above(folders, sep).join(specs, "path")
    best = met.groupBy("folder", "path", "depth").agg(F.min(F.struct(*rest)).alias("spec"))
    return best.groupBy("folder").agg(F.max_by(F.struct("path", "spec"), "depth").alias("x")).select("folder", "x.path", "x.spec.*")


def rules_chain(folders: DataFrame, rules: DataFrame, sep: str = ":") -> DataFrame:
    """folder, place from 1 and rules(path, ord, ...) that hold there, those of the folder itself first, then by folder upwards, in their order in each."""
    from pyspark.sql import Window

    met = _above(folders, sep).join(rules, "path")
    place = F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("depth"), "ord")).alias("place")
    return met.select("folder", place, "path", *(c for c in rules.columns if c != "path"))
