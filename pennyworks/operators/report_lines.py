"""Reports of gains, income and holdings: their rows, their totals, and their lines as CSV text.

Lines carry the columns that order them, so a report of any length is written by a distributed sort (sources/report_files.py).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pennyworks.functions.formats import exact, fixed
from pennyworks.operators import lots, valuation
from pennyworks.sources.scratch import written

#: Titles of sections and columns of the files.
GAIN_SECTIONS = ("Short-Term", "Long-Term", "Losses")
GAIN_HEADER = ("Commodity", "Bought", "Sold", "Quantity", "Cost", "Proceeds", "Gain/Loss", "Days")
INCOME_SECTIONS = ("Income", "Expenses")
INCOME_HEADER = ("Commodity", "Date", "Where", "Category", "Quantity", "Price", "Value")
HOLDING_HEADER = ("commodity", "quantity", "price", "price_date", "value", "portfolio_weight", "base_currency", "as_of_date")
SORT = ("section", "place", "seen", "commodity", "kind", "key")


def day_number(day: Column) -> Column:
    """A running number of days from dates as text; the leap day of a year counts from its first day on, not from March."""
    part = lambda a, n: F.substring(day, a, n).cast("int")
    y = part(1, 4)
    leaps = F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400)
    return (y * 365 + leaps + F.dayofyear(F.make_date(F.lit(2001), part(6, 2), F.lit(1))) - 1 + part(9, 2)).cast("long")


def gain_events(moves: DataFrame, order: list[str], start: str, end: str, months: int = 12, discount: float = 0.5) -> DataFrame:
    """(commodity, sale, lot, quantity, cost, proceeds, gain, days, eligible, discounted) of all disposals of moves in a window.

    moves(commodity, date, quantity, value) and `order` as in lots.match. What was sold beyond the holding is a row of its own without a lot: it cost nothing,
    was bought on the day of its sale and is never discounted.
    """
    within = F.col("sale.date").between(start, end)
    moves = lots.running(moves, order)
    found = lots.gains(lots.match(moves, order, (start, end))).where(within).select("commodity", "sale", "lot", F.col("taken").alias("quantity"), "cost", "proceeds", "gain")
    bare = lots.oversold(moves, order).where(within)
    proceeds = F.col("sale.value") * F.col("missing") / -F.col("sale.quantity")
    bare = bare.select("commodity", "sale", F.lit(None).cast(found.schema["lot"].dataType).alias("lot"), F.col("missing").alias("quantity"), F.lit(0.0).alias("cost"), proceeds.alias("proceeds"), proceeds.alias("gain"))
    rows = found.unionByName(bare)
    held = lots.whole_months(F.col("lot.date"), F.col("sale.date"))
    eligible = F.coalesce((F.col("gain") > 0) & (held >= months), F.lit(False))
    days = F.coalesce(F.abs(day_number(F.col("sale.date")) - day_number(F.col("lot.date"))), F.lit(0).cast("long"))
    return rows.withColumn("days", days).withColumn("eligible", eligible).withColumn("discounted", F.when(F.col("eligible"), F.col("gain") * (1 - discount)).otherwise(F.col("gain")))


def _sum(value: Column, when: Column | None = None) -> Column:
    """A sum that is the same in any order of rows."""
    money = exact(value, 8).cast("decimal(30,8)")
    return F.coalesce(F.sum(F.when(when, money) if when is not None else money).cast("double"), F.lit(0.0))


def gain_totals(events: DataFrame, by: list[str], discount: float = 0.5) -> DataFrame:
    """Short and long gains, losses, their net, and what is taxable when losses go against short gains first, then long ones, then the discount."""
    gain = F.col("gain")
    sums = events.groupBy(*by).agg(
        F.count("*").alias("n"), _sum(gain, (gain > 0) & ~F.col("eligible")).alias("short"), _sum(gain, (gain > 0) & F.col("eligible")).alias("long"), _sum(-gain, gain < 0).alias("losses"),
    )
    taxable, _, _ = valuation.offset_losses(F.col("short"), F.col("long"), F.col("losses"), discount)
    return sums.select(*by, "n", "short", "long", "losses", (F.col("short") + F.col("long") - F.col("losses")).alias("net"), taxable.alias("taxable"))


def _field(c: Column) -> Column:
    """A CSV field, in quotes if it must be; null is empty."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def line_of(*fields: Column | str) -> Column:
    return F.concat_ws(",", *(_field(F.lit(f) if isinstance(f, str) else f) for f in fields))


def quantity_text(c: Column) -> Column:
    """Eight decimals at most, without zeros at the end."""
    return F.regexp_replace(fixed(c, 8), r"\.?0+$", "")


def _sections(rows: DataFrame, titles: tuple[str, ...], header: tuple[str, ...], fields: list[Column], sums: dict[str, str], total: list, subtotal: list) -> DataFrame:
    """Lines of rows(section, commodity, key): each section's title, total and header, then its commodities in the order of their first rows.

    sums: names of sums of columns; total and subtotal: fields after the first, made of them. A section without rows says so.
    """
    groups = rows.groupBy("section", "commodity").agg(F.min("key").alias("seen"), *(F.sum(exact(F.col(c), 8).cast("decimal(30,8)")).alias(name) for name, c in sums.items()))
    spark, none = rows.sparkSession, F.lit(None)
    key_type = rows.schema["key"].dataType
    titled = spark.createDataFrame(list(enumerate(titles, 1)), "section int, title string")
    whole = titled.join(groups.groupBy("section").agg(F.count("*").alias("commodities"), *(F.sum(c).cast("double").alias(c) for c in sums)), "section", "left")
    for c in sums:
        whole = whole.withColumn(c, F.coalesce(c, F.lit(0.0)))
        groups = groups.withColumn(c, F.col(c).cast("double"))
    heads = F.array(
        F.struct(F.lit(0).alias("place"), line_of(F.col("title")).alias("line")), F.struct(F.lit(1).alias("place"), line_of("Section Total", *total).alias("line")),
        F.struct(F.lit(2).alias("place"), line_of(*header).alias("line")), F.when(F.col("commodities").isNull(), F.struct(F.lit(3).alias("place"), F.lit("(no events)").alias("line"))),
        F.when(F.col("section") < len(titles), F.struct(F.lit(9).alias("place"), F.lit("").alias("line"))),
    )
    top = whole.select("section", F.explode(F.filter(heads, lambda h: h.isNotNull())).alias("h"))
    top = top.select("section", "h.place", none.cast(key_type).alias("seen"), none.cast("string").alias("commodity"), F.lit(0).alias("kind"), none.cast(key_type).alias("key"), "h.line")
    ends = F.array(F.struct(F.lit(0).alias("kind"), line_of(F.col("commodity")).alias("line")), F.struct(F.lit(2).alias("kind"), line_of(F.concat("commodity", F.lit(" subtotal")), *subtotal).alias("line")))
    edges = groups.select("section", F.lit(3).alias("place"), "seen", "commodity", F.explode(ends).alias("e")).select("section", "place", "seen", "commodity", "e.kind", none.cast(key_type).alias("key"), "e.line")
    body = rows.join(groups.select("section", "commodity", "seen"), ["section", "commodity"])
    body = body.select("section", F.lit(3).alias("place"), "seen", "commodity", F.lit(1).alias("kind"), "key", line_of("", *fields).alias("line"))
    return reduce(DataFrame.unionByName, (top, edges, body))


def _cover(spark, lines: list[str], key_type) -> DataFrame:
    none = F.lit(None)
    rows = spark.createDataFrame(list(enumerate(lines)), "place int, line string")
    return rows.select(F.lit(0).alias("section"), "place", none.cast(key_type).alias("seen"), none.cast("string").alias("commodity"), F.lit(0).alias("kind"), none.cast(key_type).alias("key"), "line")


def _with_totals(cover: DataFrame, totals: DataFrame, at: int, fields: list[tuple[str, Column]]) -> DataFrame:
    """The cover with a line for each total, from the one row of totals."""
    lines = F.array(*(line_of(name, fixed(value, 2)) for name, value in fields))
    rows = totals.select(F.posexplode(lines).alias("n", "line")).select(F.lit(0).alias("section"), (F.col("n") + at).alias("place"), F.lit(0).alias("kind"), "line")
    return cover.unionByName(rows, allowMissingColumns=True)


def gain_lines(events: DataFrame, order: list[str], year: str, discount: float = 0.5) -> DataFrame:
    """The report of gain_events as lines with SORT: a cover with totals, then short-term gains, long-term gains and losses by commodity.

    Totals, groups and lines all read the events, so these are written once."""
    events = written(events, "gains")
    bought = F.coalesce("lot.date", "sale.date")
    key = F.struct(F.col("sale.date").alias("sold"), bought.alias("bought"), *(F.col(f"sale.{c}").alias(f"s{k}") for k, c in enumerate(order)), *(F.col(f"lot.{c}").alias(f"l{k}") for k, c in enumerate(order)))
    section = F.when(F.col("gain") < 0, 3).when(F.col("eligible"), 2).otherwise(1)
    rows = events.withColumn("section", section).withColumn("key", key).withColumn("bought", bought)
    money = lambda c: fixed(F.col(c), 2)
    totals = [F.lit(""), F.lit("")]
    sums = {"s_quantity": "quantity", "s_cost": "cost", "s_proceeds": "proceeds", "s_gain": "gain"}
    fields = [F.col("bought"), F.col("sale.date"), quantity_text(F.col("quantity")), money("cost"), money("proceeds"), money("gain"), F.col("days").cast("string")]
    moneys = [money("s_cost"), money("s_proceeds"), money("s_gain")]
    body = _sections(rows, GAIN_SECTIONS, GAIN_HEADER, fields, sums, [*totals, F.lit(""), *moneys], [*totals, quantity_text(F.col("s_quantity")), *moneys])
    cover = _cover(events.sparkSession, ["Capital Gains Report", f"Financial Year,{year}", "Inventory Method,FIFO", "", "Report Summary"], rows.schema["key"].dataType)
    named = [("Short Term Capital Gains", F.col("short")), ("Long Term Capital Gains", F.col("long")), ("Total Capital Losses", -F.col("losses")), ("Net Total Capital Gains", F.col("net")), ("Discounted Gain", F.col("taxable"))]
    cover = _with_totals(cover, gain_totals(events, [], discount), 5, named)
    return cover.unionByName(_blank(cover, 10)).unionByName(body)


def _blank(cover: DataFrame, place: int) -> DataFrame:
    return cover.where("place = 0").withColumn("place", F.lit(place)).withColumn("line", F.lit(""))


def income_lines(rows: DataFrame, order: list[str], year: str) -> DataFrame:
    """The report of income and expenses: rows(commodity, date, asset, account, quantity, price, value, expense) as lines with SORT. The rows are written once."""
    rows = written(rows, "income")
    rows = rows.withColumn("section", F.when(F.col("expense"), 2).otherwise(1)).withColumn("key", F.struct("date", *order))
    money = lambda c: fixed(F.col(c), 2)
    fields = [F.col("date"), F.col("asset"), F.col("account"), quantity_text(F.col("quantity")), money("price"), money("value")]
    sums = {"s_quantity": "quantity", "s_value": "value"}
    blank = [F.lit("")] * 3
    body = _sections(rows, INCOME_SECTIONS, INCOME_HEADER, fields, sums, [*blank, F.lit(""), F.lit(""), money("s_value")], [*blank, quantity_text(F.col("s_quantity")), F.lit(""), money("s_value")])
    cover = _cover(rows.sparkSession, ["Income Tax Report", f"Financial Year,{year}", "", "Report Summary"], rows.schema["key"].dataType)
    both = rows.agg(_sum(F.col("value"), ~F.col("expense")).alias("income"), _sum(F.col("value"), F.col("expense")).alias("expenses"))
    cover = _with_totals(cover, both, 4, [("Total Income", F.col("income")), ("Total Expenses", F.col("expenses")), ("Net", F.col("income") - F.col("expenses"))])
    return cover.unionByName(_blank(cover, 7)).unionByName(body)


def holding_lines(holdings: DataFrame, base: str, at: str) -> DataFrame:
    """holdings(commodity, quantity, price, price_date, value, weight) as lines by falling value, with their header."""
    six = lambda c: fixed(F.col(c), 6)
    line = line_of(F.col("commodity"), six("quantity"), six("price"), F.col("price_date"), six("value"), six("weight"), base, at)
    rows = holdings.select(F.lit(1).alias("section"), (-F.col("value")).alias("key"), "commodity", line.alias("line"))
    head = holdings.sparkSession.createDataFrame([(0, ",".join(HOLDING_HEADER))], "section int, line string")
    return head.unionByName(rows, allowMissingColumns=True)
