"""Legs joined by their ids, chain records held against a ledger, and incremental reading by a cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def partner_values(legs: DataFrame, key: list[str]) -> DataFrame:
    """legs(side, value) on side 'sell' with the summed `partner_value` of the buys of their key; summed first, so a key is one row there."""
    buys = legs.where("side = 'buy'").groupBy(*key).agg(F.sum(F.col("value").cast("decimal(24,6)")).cast("double").alias("partner_value"), F.count("*").alias("partners"))
    return legs.where("side = 'sell'").join(buys, key)


def unit_price_from_partner(quantity: Column, partner_value: Column) -> Column:
    return F.when(F.abs(quantity) > 1e-12, F.abs(partner_value) / F.abs(quantity))


def classify_links(links: DataFrame, legs: DataFrame, key: list[str]) -> DataFrame:
    """links(a_*, b_*: keys of two legs) with what they are: missing, same_folder sale and purchase, two of one side, or other folders."""
    side = lambda p: legs.select(*[F.col(k).alias(f"{p}_{k}") for k in key], F.col("account").alias(f"{p}_account"), F.signum("amount").alias(f"{p}_sign"))
    found = links.join(side("a"), [f"a_{k}" for k in key], "left").join(side("b"), [f"b_{k}" for k in key], "left")
    kind = (
        F.when(F.col("a_account").isNull() | F.col("b_account").isNull(), "missing")
        .when(F.col("a_account") != F.col("b_account"), "other_folder")
        .when(F.col("a_sign") * F.col("b_sign") < 0, "swap")
        .otherwise("same_side")
    )
    return found.withColumn("kind", kind)


def without(rows: DataFrame, *known: tuple[DataFrame, list[str]]) -> DataFrame:
    """rows that none of the tables holds by its key."""
    for table, key in known:
        rows = rows.join(table.select(*key).distinct(), key, "left_anti")
    return rows


def token_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """mint, owner and how much more the owner has after, with the owner of that mint that moved most the other way."""
    both = before.select("mint", "owner", F.col("amount").alias("x")).join(after.select("mint", "owner", F.col("amount").alias("y")), ["mint", "owner"], "full")
    delta = both.select("mint", "owner", (F.coalesce("y", F.lit(0.0)) - F.coalesce("x", F.lit(0.0))).alias("delta")).where("delta <> 0")
    most = delta.groupBy("mint").agg(F.max(F.struct("delta", "owner")).alias("up"), F.min(F.struct("delta", "owner")).alias("down"))
    other = F.when((F.col("delta") > 0) & (F.col("down.delta") < 0), F.col("down.owner")).when((F.col("delta") < 0) & (F.col("up.delta") > 0), F.col("up.owner"))
    return delta.join(most, "mint").select("mint", "owner", "delta", other.alias("counterparty"))


def reconcile(ledger: DataFrame, chain: DataFrame, key: str) -> DataFrame:
    """Keys whose amounts differ between ledger(key, amount) and chain(key, amount), and the amount that corrects the ledger."""
    total = F.sum(F.col("amount").cast("decimal(24,6)"))
    a, b = ledger.groupBy(key).agg(total.alias("a")), chain.groupBy(key).agg(total.alias("b"))
    zero = F.lit(0).cast("decimal(24,6)")
    found = a.join(b, key, "full").select(key, (F.coalesce("b", zero) - F.coalesce("a", zero)).alias("correction"))
    return found.where("correction <> 0").select(key, F.col("correction").cast("double").alias("correction"))


def newer(rows: DataFrame, at: str, seen_at: Column, seen_ids: Column, key: str) -> DataFrame:
    """rows after a cursor: later than its time, or at that time and not among the ids already seen there."""
    return rows.where((F.col(at) > seen_at) | ((F.col(at) == seen_at) & ~F.array_contains(seen_ids, F.col(key))))


def fetch_windows(rows: DataFrame, at: str, days: int) -> DataFrame:
    """Windows of so many days from the first row on, as dates, with the number of rows in each; one row of bounds is broadcast."""
    day = F.to_date(at)
    start = rows.agg(F.min(day).alias("first"))
    numbered = rows.select(day.alias("day")).join(F.broadcast(start)).select(F.floor(F.datediff("day", "first") / days).cast("int").alias("k"), "first")
    counted = numbered.groupBy("k", "first").agg(F.count("*").alias("n"))
    date = lambda k: F.date_format(F.date_add("first", k * days), "yyyy-MM-dd")
    return counted.select(date(F.col("k")).alias("start"), date(F.col("k") + 1).alias("until"), "n")


def sessions(rows: DataFrame, key: list[str], at: str, seconds: int) -> DataFrame:
    """rows with `session`, a running number that rises where a key's next row comes more than so many seconds later."""
    w = Window.partitionBy(*key).orderBy(at)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    gap = micros - F.lag(micros).over(w) > seconds * 1_000_000
    return rows.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
