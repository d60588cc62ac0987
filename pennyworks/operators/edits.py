"""Rules, accounts and links as a log of edits: the state is what the last edits leave, in whatever order the log is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def state(log: DataFrame, key: str, at: list[str], fields: list[str]) -> DataFrame:
    """key, fields and `place` of what log(key, at, op, fields) leaves; op is `put` or `delete`.

    A put sets the fields that are not null and leaves the others as they were; a delete takes all away, and a put after it begins anew. Edits
    are ordered by `at`, which is unique within a key. Entries keep the place of the put that they began with. A key is one aggregation: nothing is ordered
    but by its largest.
    """
    when = F.struct(*at)
    gone = log.groupBy(key).agg(F.max(F.when(F.col("op") == "delete", when)).alias("gone"))
    alive = log.where("op = 'put'").withColumn("_at", when).join(gone, key).where("gone is null or _at > gone")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in fields]
    return alive.groupBy(key).agg(*last, F.min("_at").alias("place")).select(key, *fields, *(F.col(f"place.{c}").alias(f"place_{c}") for c in at))


def renamed(state_: DataFrame, renames: DataFrame, column: str, at: list[str]) -> DataFrame:
    """state with the names in `column` as the last of renames(old, new, at) for each says; a chain of renames is the caller's to flatten."""
    last = renames.groupBy("old").agg(F.max_by("new", F.struct(*at)).alias("new"))
    return state_.join(last, F.col(column) == F.col("old"), "left").withColumn(column, F.coalesce("new", column)).drop("old", "new")


def anchored(rules: DataFrame, key: list[str]) -> DataFrame:
    """rules(pattern, ...) with `ord` within key: those that name one transaction by its id come before all others, each in the order of `place` columns."""
    order = [F.desc(F.col("pattern").rlike(r"^(?:txn|src|swap):\S+$")), *(F.col(c) for c in rules.columns if c.startswith("place_"))]
    return rules.withColumn("ord", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
