"""Balances, holdings, income and performance reports, each one plan over all dates and commodities that it covers."""

from __future__ import annotations

import calendar
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pennyworks.operators import lots, prices
from pennyworks.operators.balances import total
from pennyworks.operators.lots import EPSILON
from pennyworks.sources.scratch import written

#: Last segments of accounts that only pass money on.
PASSING = ("transfer", "lending", "bridge", "wrap", "staking")
ROOTS = ("assets", "equity", "liabilities")


def money(value: str) -> Column:
    return F.round(F.sum(value), 2)


def valued(rows: DataFrame, quotes: DataFrame, base: str) -> DataFrame:
    """rows(commodity, date, quantity) with their `value` in base; rows that no price reaches are left out."""
    return prices.convert(rows, quotes, base, amount="quantity").where(F.col("value").isNotNull())


def balances_report(postings: DataFrame, quotes: DataFrame, at: str, base: str) -> DataFrame:
    """commodity, quantity, value and weight on a day. The total that weights refer to is one row."""
    held = postings.where(F.col("date") <= at).groupBy("commodity").agg(total().alias("quantity")).where(F.abs("quantity") >= EPSILON)
    found = valued(held.withColumn("date", F.lit(at)), quotes, base).select("commodity", "quantity", "value")
    whole = found.agg(F.sum("value").alias("whole"))
    return found.join(F.broadcast(whole)).select("commodity", "quantity", "value", F.round(F.col("value") / F.col("whole"), 9).alias("weight"))


def leaf_accounts(balances: DataFrame) -> DataFrame:
    """Rows whose account is no ancestor of another account of the same commodity: an anti-join on listed ancestors."""
    parts = F.split("account", ":")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ":"))
    ancestors = balances.where(F.size(parts) > 1).select("commodity", F.explode(above).alias("account")).distinct()
    return balances.join(ancestors, ["commodity", "account"], "left_anti")


def child_groups(postings: DataFrame, quotes: DataFrame, at: str, base: str, depth: int = 1) -> DataFrame:
    """Market value on a day of the accounts just below a scope of `depth` segments."""
    parts = F.split("account", ":")
    wanted = parts[0].isin(*ROOTS) & ~F.lower(F.element_at(parts, -1)).isin(*PASSING)
    rows = postings.where((F.col("date") <= at) & wanted).select(F.array_join(F.slice(parts, 1, depth + 1), ":").alias("child"), "commodity", "amount")
    held = rows.groupBy("child", "commodity").agg(total().alias("quantity")).withColumn("date", F.lit(at))
    return valued(held, quotes, base).groupBy("child").agg(money("value").alias("value"))


def income_categories(postings: DataFrame, quotes: DataFrame, start: str, end: str, base: str) -> DataFrame:
    """Income, negated, and expenses of a window, in base, by account."""
    income = F.col("account").startswith("income:")
    rows = postings.where(F.col("date").between(start, end) & (income | F.col("account").startswith("expenses:")))
    rows = rows.withColumn("quantity", F.when(income, -F.col("amount")).otherwise(F.col("amount")))
    return valued(rows, quotes, base).groupBy("account").agg(F.count("*").alias("n"), money("value").alias("value"))


def snapshot_dates(start: str, end: str) -> list[str]:
    """The day before the window, the month ends within it, and its end."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    found, day = [first - timedelta(days=1)], first
    while (month_end := day.replace(day=calendar.monthrange(day.year, day.month)[1])) < last:
        found.append(month_end)
        day = month_end + timedelta(days=1)
    return [d.isoformat() for d in (*found, last)]


def performance_points(postings: DataFrame, quotes: DataFrame, start: str, end: str, base: str) -> DataFrame:
    """date, value and number of priced commodities at each snapshot.

    A posting counts from the first snapshot on or after it. Amounts are summed by commodity and snapshot
    first, so the running sums see at most one row for each of these.
    """
    days = F.array(*map(F.lit, snapshot_dates(start, end)))
    first = F.get(F.filter(days, lambda d: d >= F.col("date")), F.lit(0))
    moved = postings.select("commodity", "amount", first.alias("date")).where(F.col("date").isNotNull())
    moved = moved.groupBy("commodity", "date").agg(F.sum(F.col("amount").cast("decimal(24,6)")).alias("moved"))
    due = moved.select("commodity").distinct().select("commodity", F.explode(days).alias("date"))
    w = Window.partitionBy("commodity").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    held = due.join(moved, ["commodity", "date"], "left").select("commodity", "date", F.sum("moved").over(w).cast("double").alias("quantity"))
    return valued(held.where(F.abs("quantity") >= EPSILON), quotes, base).groupBy("date").agg(F.count("*").alias("n"), money("value").alias("value"))


def attribution(events: DataFrame, order: list[str], quotes: DataFrame, start: str, end: str, base: str, names: DataFrame | None = None) -> DataFrame:
    """What each commodity gained in a window: realised, unrealised and in all.

    events(commodity, date, quantity, value) are what was bought and sold, in the order of lots.match. Lots from before the window cost what they
    were worth on the day before it, so the whole is the value at the end less that at the start and what was put in. Events after the window only make
    their commodity a row; so they are looked for only if one of `names`, all commodities that may have events, has none before.
    """
    before = (date.fromisoformat(start) - timedelta(days=1)).isoformat()
    quotes = written(quotes.where(F.col("date") <= end).select("commodity", "date", "price", "quote"), "quotes")
    sums = written(lots.turnover(events, order, start, end), "sums")
    rest = (events if names is None else names).where("commodity is not null").select("commodity").distinct().join(sums, "commodity", "left_anti")
    if not rest.isEmpty():
        sums = sums.unionByName(events.join(rest, "commodity", "left_semi").select("commodity").distinct(), allowMissingColumns=True).na.fill(0.0)
    held = sums.withColumn("one", F.lit(1.0)).withColumn("day0", F.lit(before)).withColumn("day1", F.lit(end))
    priced = prices.convert(held, quotes, base, amount="one", at="day0", held=True).withColumnRenamed("value", "unit0")
    priced = prices.convert(priced, quotes, base, amount="one", at="day1", held=True).withColumnRenamed("value", "unit1")
    value = lambda k: F.when(F.abs(f"q{k}") < EPSILON, 0.0).otherwise(F.col(f"q{k}") * F.col(f"unit{k}"))
    realised = F.col("got") - F.col("spent") - F.when(F.col("old") < EPSILON, 0.0).otherwise(F.col("old") * F.col("unit0"))
    total_gain = value(1) - value(0) - F.col("paid") + F.col("received")
    found = priced.select("commodity", realised.alias("realised"), (total_gain - realised).alias("unrealised"), total_gain.alias("total_gain"))
    return found.where("total_gain is not null").select("commodity", *(F.round(c, k).alias(c) for c, k in (("realised", 4), ("unrealised", 4), ("total_gain", 4))))


def positions(open_lots: DataFrame, quotes: DataFrame, at: str, base: str) -> DataFrame:
    """Per commodity of open lots: quantity, cost, and value on a day in base, the money that the lots were paid in."""
    held = open_lots.groupBy("commodity").agg(F.sum("left").alias("quantity"), money("cost").alias("cost"), F.count("*").alias("lots"))
    return valued(held.withColumn("date", F.lit(at)), quotes, base).select("commodity", "quantity", "lots", "cost", "value")


def gain_sections(gains: DataFrame) -> DataFrame:
    """Subtotals of gains(commodity, gain, discount_eligible) by section and commodity, by section, and in all."""
    section = F.when(F.col("gain") < 0, "Losses").when(F.col("discount_eligible"), "Long-Term").otherwise("Short-Term")
    return gains.withColumn("section", section).rollup("section", "commodity").agg(F.count("*").alias("n"), money("gain").alias("gain"))
