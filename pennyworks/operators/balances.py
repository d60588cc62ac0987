"""Balances by account and commodity, and what is derived from them. Sums are taken in decimals, so their order does not matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pennyworks.functions.patterns import in_scope

MONEY = "decimal(24,6)"


def total(amount: str = "amount") -> Column:
    return F.sum(F.col(amount).cast(MONEY)).cast("double")


def balances(postings: DataFrame, openings: DataFrame | None = None) -> DataFrame:
    """account, commodity, amount; openings(account, commodity, amount) are added."""
    rows = postings.select("account", "commodity", "amount")
    rows = rows if openings is None else rows.unionByName(openings.select("account", "commodity", "amount"))
    return rows.groupBy("account", "commodity").agg(total().alias("amount"))


def scoped(postings: DataFrame, prefix: str) -> DataFrame:
    return balances(postings.where(in_scope(F.col("account"), prefix)))


def tree_rollup(leaf: DataFrame) -> DataFrame:
    """Every ancestor of every account, itself among them, with the sum below it."""
    parts = F.split("account", ":")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ":"))
    return leaf.select(F.explode(paths).alias("account"), "commodity", "amount").groupBy("account", "commodity").agg(total().alias("amount"))


def uncategorised(txns: DataFrame) -> DataFrame:
    """Per assets account, transactions with under two postings or accounts, or with an unknown expense."""
    accounts = F.transform("postings", lambda p: p["account"])
    bad = (F.size("postings") < 2) | (F.size(F.array_distinct(accounts)) < 2) | F.array_contains(accounts, "expenses:unknown")
    assets = F.filter(F.array_distinct(accounts), lambda a: a.startswith("assets:"))
    return txns.where(bad).select(F.explode(assets).alias("account")).groupBy("account").agg(F.count("*").alias("n"))


def month_gaps(postings: DataFrame) -> DataFrame:
    """Months between an assets account's first and last posting in which it has none."""
    month = F.trunc(F.to_date("date"), "month")
    seen = postings.where(F.col("account").startswith("assets:")).select("account", month.alias("m")).distinct()
    spans = seen.groupBy("account").agg(F.collect_set("m").alias("have"), F.sequence(F.min("m"), F.max("m"), F.expr("interval 1 month")).alias("due"))
    return spans.select("account", F.explode(F.array_except("due", "have")).alias("m")).select("account", F.date_format("m", "yyyyMM").alias("month"))
