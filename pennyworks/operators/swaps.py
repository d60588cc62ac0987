"""Legs that belong together: pairs by rank, neighbours, renames and transfers between own accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pennyworks.functions.patterns import wildcard


def rank_pairs(legs: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The k-th disposal and the k-th acquisition of a group, each by size, if their commodities differ; a surplus stays alone.

    The join is an equality on the group and the rank, so it gives one row a pair whatever a group's size.
    """
    side = F.when(F.col("amount") < 0, "sell").when(F.col("amount") > 0, "buy")
    by_size = Window.partitionBy(*group, "side").orderBy(F.abs("amount"), *order)
    ranked = legs.withColumn("side", side).where(F.col("side").isNotNull()).withColumn("k", F.row_number().over(by_size))
    leg = F.struct(*dict.fromkeys([*order, "commodity", "amount"]))
    sells = ranked.where("side = 'sell'").select(*group, "k", leg.alias("sell"))
    buys = ranked.where("side = 'buy'").select(*group, "k", leg.alias("buy"))
    return sells.join(buys, [*group, "k"]).where(F.col("sell.commodity") != F.col("buy.commodity"))


def adjacent_pairs(legs: DataFrame, order: list[str]) -> DataFrame:
    """legs followed, in their account and on their day, by one of another commodity and the opposite sign, as `next`."""
    w = Window.partitionBy("account", "date").orderBy(*order)
    after = legs.withColumn("next", F.lead(F.struct(*dict.fromkeys([*order, "commodity", "amount"]))).over(w))
    other, opposite = F.col("commodity") != F.col("next.commodity"), F.col("amount") * F.col("next.amount") < 0
    return after.where(other & opposite & (F.abs("amount") > 1e-9) & (F.abs("next.amount") > 1e-9))


def rename_all(value: Column, renames: list[tuple[str, str]]) -> Column:
    """Every rename whose pattern fits, in order, each on what the ones before made of the value."""
    for pattern, name in renames:
        value = F.when(wildcard(value, pattern), F.lit(name)).otherwise(value)
    return value


def rename_first(value: Column, renames: list[tuple[str, str]]) -> Column:
    """The first rename whose pattern fits, else null."""
    fits = [F.when(wildcard(value, pattern), F.lit(name)) for pattern, name in renames]
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def self_transfer(text: Column, accounts: list[str]) -> Column:
    """The first declared account whose last segment, of four characters or more, is in the text; else null."""
    low = F.lower(text)
    names = [(a, a.rsplit(":", 1)[-1].lower()) for a in accounts]
    fits = [F.when(low.contains(name), F.lit(account)) for account, name in names if len(name) >= 4]
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def blank_leg(known: Column) -> Column:
    """The amount of an entry's one blank leg: what its known amounts, an array, leave open."""
    return -F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
