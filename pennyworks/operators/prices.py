"""As-of prices and conversion by at most one intermediate commodity."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pennyworks.sources.scratch import written


def _month(date: Column) -> Column:
    """A date's month, counted from year 0; null if the text is no date."""
    return F.substring(date, 1, 4).try_cast("int") * 12 + F.substring(date, 6, 2).try_cast("int")


def as_of(requests: DataFrame, prices: DataFrame, commodity: str, at: str, into: str, first_if_none: bool = False) -> DataFrame:
    """requests with a struct column `into` (price, quote): the last price of the commodity not after `at`, or null.

    Only the prices are grouped: a row a commodity and month, from its first to its last, with the month's prices (one a date, so at
    most 31) and the last one before it. Requests are read once and meet these by equality, so a plan of two hops does not multiply them.
    """
    quotes = prices.where(F.col("commodity").isNotNull()).groupBy("commodity", "date").agg(F.max(F.struct("price", "quote")).alias("p"))
    quotes = quotes.select(F.col("commodity").alias("_c"), _month(F.col("date")).alias("_m"), F.struct(F.col("date").alias("d"), "p").alias("q")).where("_m is not null")
    months = quotes.groupBy("_c", "_m").agg(F.sort_array(F.collect_list("q")).alias("_qs"), F.max("q")["p"].alias("last"), F.min("q")["p"].alias("first"))
    w = Window.partitionBy("_c").orderBy("_m")
    spans = months.select("_c", F.col("_m").alias("from"), "_qs", "last", F.lag("last").over(w).alias("before"), F.coalesce(F.lead("_m").over(w) - 1, "_m").alias("until"))
    spans = spans.select("*", F.explode(F.sequence("from", "until")).alias("_m"))
    own = F.col("_m") == F.col("from")
    spans = spans.select("_c", "_m", F.when(own, F.col("_qs")).alias("_qs"), F.when(own, F.col("before")).otherwise(F.col("last")).alias("_carried"))
    ends = months.groupBy(F.col("_c").alias("_e")).agg(F.max("_m").alias("_end"), F.max_by("last", "_m").alias("_last"), F.min_by("first", "_m").alias("_first"))
    month = _month(F.col(at))
    met = requests.join(spans, (F.col(commodity) == F.col("_c")) & (month == F.col("_m")), "left").join(ends, F.col(commodity) == F.col("_e"), "left")
    near = F.array_max(F.filter("_qs", lambda q: q["d"] <= F.col(at)))["p"]
    found = F.coalesce(near, "_carried", F.when(month > F.col("_end"), F.col("_last")), *([F.when(month.isNotNull(), F.col("_first"))] if first_if_none else []))
    return met.withColumn(into, found).drop("_c", "_m", "_qs", "_carried", "_e", "_end", "_last", "_first")


def convert(requests: DataFrame, prices: DataFrame, base: str, amount: str = "amount", commodity: str = "commodity", at: str = "date", held: bool = False) -> DataFrame:
    """requests with `value` in base: itself, by the price at the time, or by that of its quote at the same time; else null.

    The prices are written once. So both hops read them, not what they are made of, and as their size is known, requests are not shuffled to meet a small table.
    `held` says that they are written already.
    """
    prices = written(prices.select("commodity", "date", "price", "quote"), "quotes") if not held else prices
    two = hops(requests, prices, commodity, at)
    return two.withColumn("value", in_base(F.col(amount), F.col(commodity), base)).drop("_p1", "_p2")


def hops(requests: DataFrame, prices: DataFrame, commodity: str, at: str) -> DataFrame:
    """requests with `_p1`, the price at the time, and `_p2`, that of its quote at the same time."""
    one = as_of(requests, prices, commodity, at, "_p1").withColumn("_q", F.col("_p1.quote"))
    return as_of(one, prices, "_q", at, "_p2").drop("_q")


def in_base(amount: Column, commodity: Column, base: str) -> Column:
    """An amount of a commodity in base: itself, by `_p1`, or by `_p1` and `_p2`; else null."""
    hop = F.when(F.col("_p2.quote") == base, amount * F.col("_p1.price") * F.col("_p2.price"))
    return F.when(commodity == base, amount).when(F.col("_p1.quote") == base, amount * F.col("_p1.price")).otherwise(hop)


def latest(prices: DataFrame) -> DataFrame:
    """commodity, price, quote of the last date."""
    last = prices.groupBy("commodity").agg(F.max_by(F.struct("price", "quote"), "date").alias("p"))
    return last.select("commodity", "p.price", "p.quote")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """All of new, and what old has for other dates of each commodity."""
    return new.unionByName(old.join(new.select("commodity", "date").distinct(), ["commodity", "date"], "left_anti").select(*new.columns))


def first_fresh(quotes: DataFrame, sources: DataFrame, at: str, max_age: int) -> DataFrame:
    """commodity, source and last date of the first of sources(commodity, source, ord) whose newest of quotes(commodity, source, date, ...) is at most so many days old.

    Only a row a commodity and source is ordered. Commodities without a fresh source are left out, and stale() tells them.
    """
    newest = quotes.groupBy("commodity", "source").agg(F.max("date").alias("last"))
    fresh = sources.join(newest, ["commodity", "source"]).where(F.datediff(F.lit(at).cast("date"), F.col("last").cast("date")) <= max_age)
    return fresh.groupBy("commodity").agg(F.min_by(F.struct("source", "last"), F.struct("ord", "source")).alias("s")).select("commodity", "s.source", "s.last")


def stale(quotes: DataFrame, sources: DataFrame, at: str, max_age: int) -> DataFrame:
    """commodity and how many sources were tried of those that have none that is fresh."""
    return sources.join(first_fresh(quotes, sources, at, max_age), "commodity", "left_anti").groupBy("commodity").agg(F.count("*").alias("tried"))


def write_files(prices: DataFrame, path: str) -> None:
    """Price lines in a folder for each commodity, by date; a price of a date that is there already replaces it, see merge()."""
    line = F.concat_ws(" ", F.lit("P"), "date", "commodity", F.col("price").cast("decimal(38,10)").cast("string"), "quote").alias("value")
    rows = prices.select("commodity", "date", line).repartition("commodity").sortWithinPartitions("commodity", "date")
    rows.select(F.col("commodity").alias("of"), "value").write.partitionBy("of").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)


def upsert(spark: SparkSession, prices: DataFrame, path: str) -> None:
    """Prices put into the files below path: only the folders of their commodities are read and written again."""
    from pennyworks.sources.ledger_text import price_lines

    try:
        old = spark.read.text(path)
    except AnalysisException:  # no files yet
        write_files(prices, path)
        return
    touched = prices.select(F.col("commodity").alias("of")).distinct()
    held = price_lines(old.join(touched, "of", "left_semi").select("value"))
    write_files(written(merge(held, prices.select(*held.columns)), "prices"), path)
