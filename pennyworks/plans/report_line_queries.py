"""Reports of gains, income and holdings on the driver's tables, with what was sold beyond the holding, and as lines of CSV; each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pennyworks.functions.formats import exact
from pennyworks.operators import prices, report_lines
from pennyworks.plans import catalog, ledger
from pennyworks.plans.catalog import KEY, query

START, END, YEAR = "1996-07-01", "1997-06-30", "1997"
_FIRST, _LAST = "0001-01-01", "9999-12-31"

_DAYS = "(CAST(SUBSTRING({0}, 1, 4) AS INT) * 365 + CAST(SUBSTRING({0}, 1, 4) AS INT) // 4 - CAST(SUBSTRING({0}, 1, 4) AS INT) // 100 + CAST(SUBSTRING({0}, 1, 4) AS INT) // 400 + dayofyear(make_date(2001, CAST(SUBSTRING({0}, 6, 2) AS INT), 1)) + CAST(SUBSTRING({0}, 9, 2) AS INT))"
#: Lots by account: a pool is an account's commodity.
EVENTS_SQL = f""", pool AS (SELECT * REPLACE (account || ' ' || commodity AS commodity) FROM line){catalog.LOTS_SQL.replace("FROM line", "FROM pool")},
    missed AS (SELECT commodity, date, l_orderkey, l_linenumber, net, -q AS sold, -q - (d - d0) AS missing FROM g WHERE q < 0 AND -q - (d - d0) > 1e-10),
    every AS (SELECT commodity, sell_date, sell_order, sell_line, buy_date, buy_order, buy_line, taken AS quantity, cost, proceeds FROM t
      UNION ALL SELECT commodity, date, l_orderkey, l_linenumber, NULL, NULL, NULL, missing, 0, net * missing / sold FROM missed),
    gained AS (SELECT *, proceeds - cost AS gain, COALESCE({_DAYS.format("sell_date")} - {_DAYS.format("buy_date")}, 0) AS days,
      COALESCE(proceeds - cost > 0 AND (CAST(SUBSTRING(sell_date, 1, 4) AS INT) - CAST(SUBSTRING(buy_date, 1, 4) AS INT)) * 12 + CAST(SUBSTRING(sell_date, 6, 2) AS INT)
      - CAST(SUBSTRING(buy_date, 6, 2) AS INT) - CASE WHEN SUBSTRING(sell_date, 9, 2) < SUBSTRING(buy_date, 9, 2) THEN 1 ELSE 0 END >= 12, FALSE) AS eligible FROM every)"""


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.lot_events(spark, sf_dir, pool=F.concat_ws(" ", "account", "commodity"))


_ORDER = [*KEY, "quantity", "value"]


@query(f"{EVENTS_SQL} SELECT commodity, sell_date, sell_order, sell_line, buy_date, buy_order, buy_line, quantity, cost, proceeds, gain, CAST(days AS BIGINT) AS days, eligible, CASE WHEN eligible THEN gain * 0.5 ELSE gain END AS discounted FROM gained WHERE sell_date BETWEEN '{START}' AND '{END}'")
def cgt_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gains of a financial year, what was sold beyond the holding among them."""
    found = report_lines.gain_events(_moves(spark, sf_dir), _ORDER, START, END)
    ends = [F.col(f"{side}.{c}").alias(f"{name}_{as_}") for side, name in (("sale", "sell"), ("lot", "buy")) for c, as_ in (("date", "date"), ("l_orderkey", "order"), ("l_linenumber", "line"))]
    return found.select("commodity", *ends, "quantity", "cost", "proceeds", "gain", "days", "eligible", "discounted")


def _total(name: str, when: str) -> str:
    return f"COALESCE(CAST(SUM(CAST(ABS(gain) AS DECIMAL(30,8))) FILTER ({when}) AS DOUBLE), 0) AS {name}"


_TOTALS = f"COUNT(*) AS n, {_total('short', 'gain > 0 AND NOT eligible')}, {_total('long', 'gain > 0 AND eligible')}, {_total('losses', 'gain < 0')}"
_TAXED = "GREATEST(short - losses, 0) + GREATEST(long - GREATEST(losses - short, 0), 0) * 0.5"


@query(f"""{EVENTS_SQL}, y AS (SELECT CAST(SUBSTRING(sell_date, 1, 4) AS INT) + CASE WHEN SUBSTRING(sell_date, 6, 5) > '06-30' THEN 1 ELSE 0 END AS fy, {_TOTALS} FROM gained GROUP BY 1)
    SELECT fy, n, ROUND(short, 2) AS short, ROUND(long, 2) AS long, ROUND(losses, 2) AS losses, ROUND(short + long - losses, 2) AS net, ROUND({_TAXED}, 2) AS taxable FROM y""")
def cgt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report_lines.gain_events(_moves(spark, sf_dir), _ORDER, _FIRST, _LAST)
    day = F.col("sale.date")
    fy = F.substring(day, 1, 4).cast("int") + (F.substring(day, 6, 5) > "06-30").cast("int")
    totals = report_lines.gain_totals(found.withColumn("fy", fy), ["fy"])
    return totals.select("fy", "n", *(F.round(c, 2).alias(c) for c in ("short", "long", "losses", "net", "taxable")))


def _money(c: str) -> str:
    return f"CAST(CAST(CAST({c} AS DECIMAL(38,10)) AS DECIMAL(38,2)) AS VARCHAR)"


def _summed(c: str) -> str:
    return _money(f"CAST(SUM(CAST({c} AS DECIMAL(30,8))) AS DOUBLE)")


def _qty(c: str) -> str:
    return f"regexp_replace(CAST(CAST(CAST({c} AS DECIMAL(38,10)) AS DECIMAL(38,8)) AS VARCHAR), '\\.?0+$', '')"


def _sections_sql(titles: tuple[str, ...], header: tuple[str, ...], total: str, subtotal: str, fields: str) -> str:
    """Lines of the table r(section, commodity, seen, ...)."""
    named = ", ".join(f"({k}, '{title}')" for k, title in enumerate(titles, 1))
    return f"""s(section, title) AS (VALUES {named}), tot AS (SELECT section, {total} AS line FROM s LEFT JOIN r USING (section) GROUP BY 1),
    first AS (SELECT section, commodity, MIN(seen) AS seen FROM r GROUP BY 1, 2),
    body AS (SELECT section, 0 AS place, NULL AS commodity, NULL AS seen, 0 AS kind, title AS line FROM s
      UNION ALL SELECT section, 1, NULL, NULL, 0, line FROM tot UNION ALL SELECT section, 2, NULL, NULL, 0, '{",".join(header)}' FROM s
      UNION ALL SELECT section, 3, NULL, NULL, 0, '(no events)' FROM s WHERE section NOT IN (SELECT section FROM r)
      UNION ALL SELECT section, 9, NULL, NULL, 0, '' FROM s WHERE section < {len(titles)}
      UNION ALL SELECT section, 3, commodity, seen, 0, commodity FROM first
      UNION ALL SELECT section, 3, commodity, first.seen, 1, {fields} FROM r JOIN first USING (section, commodity)
      UNION ALL SELECT section, 3, commodity, MIN(seen), 2, commodity || ' subtotal,' || {subtotal} FROM r GROUP BY 1, 2, 3)"""


def _shown(lines: DataFrame) -> DataFrame:
    """Lines and what orders them, but for the order of a commodity's rows."""
    return lines.select("section", "place", "commodity", F.col(f"seen.{lines.schema['seen'].dataType.names[0]}").alias("seen"), "kind", "line")


@query(f"""{EVENTS_SQL}, r AS (SELECT CASE WHEN gain < 0 THEN 3 WHEN eligible THEN 2 ELSE 1 END AS section, sell_date AS seen, * FROM gained WHERE sell_date BETWEEN '{START}' AND '{END}'),
    w AS (SELECT {_TOTALS} FROM r),
    {_sections_sql(report_lines.GAIN_SECTIONS, report_lines.GAIN_HEADER, f"'Section Total,,,,' || COALESCE({_summed('cost')}, '0.00') || ',' || COALESCE({_summed('proceeds')}, '0.00') || ',' || COALESCE({_summed('gain')}, '0.00')",
      f"',,' || {_qty('CAST(SUM(CAST(quantity AS DECIMAL(30,8))) AS DOUBLE)')} || ',' || {_summed('cost')} || ',' || {_summed('proceeds')} || ',' || {_summed('gain')}",
      f"',' || COALESCE(buy_date, sell_date) || ',' || sell_date || ',' || {_qty('quantity')} || ',' || {_money('cost')} || ',' || {_money('proceeds')} || ',' || {_money('gain')} || ',' || days")},
    cover AS (SELECT UNNEST([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]) AS place, UNNEST(['Capital Gains Report', 'Financial Year,{YEAR}', 'Inventory Method,FIFO', '', 'Report Summary', 'Short Term Capital Gains,' || {_money('short')},
      'Long Term Capital Gains,' || {_money('long')}, 'Total Capital Losses,' || {_money('-losses')}, 'Net Total Capital Gains,' || {_money('short + long - losses')}, 'Discounted Gain,' || {_money(_TAXED)}, '']) AS line FROM w)
    SELECT section, place, commodity, seen, kind, line FROM body UNION ALL SELECT 0, place, NULL, NULL, 0, line FROM cover""")
def cgt_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = report_lines.gain_events(_moves(spark, sf_dir), _ORDER, START, END)
    return _shown(report_lines.gain_lines(events, _ORDER, YEAR))


def income_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seventh lines as rewards, sixth ones as gifts, at the price in base of their day."""
    rows = ledger.lines(spark, sf_dir).where(f"l_linenumber >= 6 AND date BETWEEN '{START}' AND '{END}'").withColumn("one", F.lit(1.0)).drop("value")
    rows = prices.convert(rows, ledger.prices(spark, sf_dir), "AUD", amount="one").withColumn("price", F.coalesce("value", F.lit(0.0)))
    account = F.when(F.col("l_linenumber") == 7, "income:rewards").otherwise("expenses:gifts")
    return rows.select("commodity", "date", *KEY, F.col("account").alias("asset"), account.alias("account"), F.col("qty").alias("quantity"), "price", (F.col("qty") * F.col("price")).alias("value"), (F.col("l_linenumber") == 6).alias("expense"))


@query(f""", b AS (SELECT *, date AS seen FROM line WHERE l_linenumber >= 6 AND date BETWEEN '{START}' AND '{END}'),
    one AS (SELECT b.*, p.price AS p1, p.quote AS q1 FROM b ASOF LEFT JOIN price p ON b.commodity = p.commodity AND b.date >= p.date),
    r AS (SELECT CASE WHEN l_linenumber = 6 THEN 2 ELSE 1 END AS section, one.commodity, one.date, seen, account AS asset, CASE WHEN l_linenumber = 7 THEN 'income:rewards' ELSE 'expenses:gifts' END AS account, qty AS quantity,
      COALESCE(CASE WHEN q1 = 'AUD' THEN p1 WHEN p.quote = 'AUD' THEN p1 * p.price END, 0) AS price, qty * COALESCE(CASE WHEN q1 = 'AUD' THEN p1 WHEN p.quote = 'AUD' THEN p1 * p.price END, 0) AS value
      FROM one ASOF LEFT JOIN price p ON one.q1 = p.commodity AND one.date >= p.date),
    w AS (SELECT COALESCE(CAST(SUM(CAST(value AS DECIMAL(30,8))) FILTER (section = 1) AS DOUBLE), 0) AS income, COALESCE(CAST(SUM(CAST(value AS DECIMAL(30,8))) FILTER (section = 2) AS DOUBLE), 0) AS expenses FROM r),
    {_sections_sql(report_lines.INCOME_SECTIONS, report_lines.INCOME_HEADER, f"'Section Total,,,,,,' || COALESCE({_summed('value')}, '0.00')", f"',,,' || {_qty('CAST(SUM(CAST(quantity AS DECIMAL(30,8))) AS DOUBLE)')} || ',,' || {_summed('value')}",
      f"',' || date || ',' || asset || ',' || account || ',' || {_qty('quantity')} || ',' || {_money('price')} || ',' || {_money('value')}")},
    cover AS (SELECT UNNEST([0, 1, 2, 3, 4, 5, 6, 7]) AS place, UNNEST(['Income Tax Report', 'Financial Year,{YEAR}', '', 'Report Summary', 'Total Income,' || {_money('income')}, 'Total Expenses,' || {_money('expenses')}, 'Net,' || {_money('income - expenses')}, '']) AS line FROM w)
    SELECT section, place, commodity, seen, kind, line FROM body UNION ALL SELECT 0, place, NULL, NULL, 0, line FROM cover""")
def income_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(report_lines.income_lines(income_rows(spark, sf_dir), KEY, YEAR))


def _six(c: str) -> str:
    return f"CAST(CAST(CAST({c} AS DECIMAL(38,10)) AS DECIMAL(38,6)) AS VARCHAR)"


@query(f""", h AS (SELECT commodity, CAST(SUM(CAST(sgn * qty AS DECIMAL(24,6))) AS DOUBLE) AS quantity FROM line WHERE date <= '{END}' GROUP BY 1),
    l AS (SELECT commodity, arg_max(price, date) AS price, MAX(date) AS price_date FROM price WHERE quote = 'USD' AND date <= '{END}' GROUP BY 1),
    v AS (SELECT *, quantity * price AS value FROM h JOIN l USING (commodity)), a AS (SELECT CAST(SUM(CAST(value AS DECIMAL(30,8))) AS DOUBLE) AS whole FROM v)
    SELECT commodity, commodity || ',' || {_six("quantity")} || ',' || {_six("price")} || ',' || price_date || ',' || {_six("value")} || ',' || {_six("value / whole")} || ',USD,{END}' AS line FROM v, a
    UNION ALL SELECT NULL, '{",".join(report_lines.HOLDING_HEADER)}'""")
def balances_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ledger.lines(spark, sf_dir).where(F.col("date") <= END).groupBy("commodity").agg(F.sum((F.col("sgn") * F.col("qty")).cast("decimal(24,6)")).cast("double").alias("quantity"))
    quotes = ledger.prices(spark, sf_dir).where((F.col("quote") == "USD") & (F.col("date") <= END)).groupBy("commodity").agg(F.max_by("price", "date").alias("price"), F.max("date").alias("price_date"))
    rows = held.join(quotes, "commodity").withColumn("value", F.col("quantity") * F.col("price"))
    whole = rows.agg(F.sum(exact(F.col("value"), 8).cast("decimal(30,8)")).cast("double").alias("whole"))
    rows = rows.join(F.broadcast(whole)).withColumn("weight", F.col("value") / F.col("whole"))  # one row
    return report_lines.holding_lines(rows, "USD", END).select("commodity", "line")
