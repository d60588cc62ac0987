"""The library's queries on the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pennyworks.functions import search
from pennyworks.operators import balances as B
from pennyworks.operators import lots, prices, report_lines, rules
from pennyworks.plans import ledger
from pennyworks.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = ["l_orderkey", "l_linenumber"]
_SUM = "CAST(SUM(CAST(amount AS DECIMAL(24,6))) AS DOUBLE)"


def query(sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql if "FROM events" in sql else f"WITH {ledger.SQL_WITH} {sql}"
        return f

    return put


def _search(name: str, text: str, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ledger.transactions(spark, sf_dir).where(search.condition(text)).select(*KEY, "date")

    run.__name__ = name
    query(f"SELECT l_orderkey, l_linenumber, date FROM line WHERE {where}")(run)


_search("search_payee", "payee:customer#0000000.1", "regexp_matches(payee, 'customer#0000000.1', 'i')")
_search("search_date_range", "date:1995-03-01..1995-03-31", "date BETWEEN '1995-03-01' AND '1995-03-31'")
_search("search_account_any", "account:asia:nation_(2|7)", "regexp_matches(account, 'asia:nation_(2|7)', 'i')")
_search("search_commodity", "commodity:brand_1*", "regexp_matches(commodity, '^brand_1.*$', 'i')")
_search("search_amount", "amount:>=45 AND -payee:9", "sgn * qty >= 45 AND NOT regexp_matches(payee, '9')")
_search("search_fee", "fee:>4000 OR amount:<-48", "(fee > 0 AND fee > 4000) OR sgn * qty < -48")
_search("search_narration_or_meta", "narration:urgent AND date:>=1997-06-01 OR meta:src:line:6", "(regexp_matches(narration, 'urgent', 'i') AND date >= '1997-06-01') OR regexp_matches(meta, 'src:line:6', 'i')")
_search("search_free_text", "customer#0+12 .*(high|urgent)", "regexp_matches(payee || ' ' || narration, 'customer#0+12 .*(high|urgent)', 'i')")


@query(f"SELECT account, commodity, {_SUM} AS amount FROM posting GROUP BY 1, 2")
def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.balances(ledger.sums_by_account(spark, sf_dir))


@query(
    """, o AS (SELECT 'assets:' || LOWER(REPLACE(r_name, ' ', '_')) || ':' || LOWER(REPLACE(n_name, ' ', '_')) AS account, 'USD' AS commodity, c_acctbal AS amount
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    a AS (SELECT account, commodity, amount FROM posting UNION ALL SELECT * FROM o)
    SELECT account, commodity, CAST(SUM(CAST(amount AS DECIMAL(24,6))) AS DOUBLE) AS amount FROM a GROUP BY 1, 2"""
)
def opening_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances on top of what customers' accounts open with."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    name = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("_")))
    homes = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    openings = homes.select(F.concat_ws(":", F.lit("assets"), name("r_name"), name("n_name")).alias("account"), F.lit("USD").alias("commodity"), F.col("c_acctbal").alias("amount"))
    return B.balances(ledger.sums_by_account(spark, sf_dir), openings)


@query(f"SELECT account, commodity, {_SUM} AS amount FROM posting WHERE account = 'assets:asia' OR account LIKE 'assets:asia:%' GROUP BY 1, 2")
def balances_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.scoped(ledger.postings(ledger.transactions(spark, sf_dir)), "assets:asia")


@query(
    f"""SELECT array_to_string(list_slice(string_split(account, ':'), 1, k), ':') AS account, commodity, {_SUM} AS amount
    FROM posting, range(1, 4) t(k) WHERE k <= len(string_split(account, ':')) GROUP BY 1, 2"""
)
def account_tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.tree_rollup(B.balances(ledger.sums_by_account(spark, sf_dir)))


@query(
    """, m AS (SELECT DISTINCT account, date_trunc('month', CAST(date AS DATE)) AS m FROM posting WHERE account LIKE 'assets:%'),
    b AS (SELECT account, MIN(m) AS lo, MAX(m) AS hi FROM m GROUP BY 1),
    d AS (SELECT account, UNNEST(generate_series(lo, hi, INTERVAL 1 MONTH)) AS m FROM b)
    SELECT d.account, strftime(d.m, '%Y%m') AS month FROM d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.account = d.account AND m.m = d.m)"""
)
def account_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.month_gaps(ledger.postings(ledger.transactions(spark, sf_dir)))


@query("SELECT commodity, COUNT(*) AS n FROM posting WHERE account LIKE 'assets:%' GROUP BY 1")
def held_commodities(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ledger.postings(ledger.transactions(spark, sf_dir)).where(F.col("account").startswith("assets:"))
    return held.groupBy("commodity").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT CAST(SUBSTRING(date, 1, 4) AS INT) + CASE WHEN SUBSTRING(date, 6, 5) > '06-30' THEN 1 ELSE 0 END AS fy FROM line")
def financial_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.substring("date", 1, 4).cast("int") + (F.substring("date", 6, 5) > "06-30").cast("int")
    return ledger.lines(spark, sf_dir).select(year.alias("fy")).distinct()


@query(
    """, s AS (SELECT l_orderkey, COUNT(*) AS legs, COUNT(DISTINCT commodity) AS kinds FROM line WHERE ABS(qty) >= 1e-9 GROUP BY 1)
    SELECT l_orderkey, l_linenumber, COALESCE(legs = kinds AND legs IN (2, 3), FALSE) AS is_swap FROM line LEFT JOIN s USING (l_orderkey)"""
)
def is_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.with_swap_label(ledger.transactions(spark, sf_dir)).select(*KEY, "is_swap")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN COUNT(*) OVER (PARTITION BY l_orderkey) >= 2
    THEN ROW_NUMBER() OVER (PARTITION BY l_orderkey, commodity, sgn * qty ORDER BY l_linenumber) - 1 END AS leg FROM line"""
)
def leg_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = ledger.lines(spark, sf_dir).select("oid", *KEY, "commodity", (F.col("sgn") * F.col("qty")).alias("amount"))
    return rules.leg_ids(legs).select(*KEY, F.col("leg").cast("long").alias("leg"))


RULES = [
    rules.Rule("large", "*", amount=">=45", account="income:large"),
    rules.Rule("urgent", "1-*|2-*", field="narration", account="expenses:urgent"),
    rules.Rule("brand", "Brand_3*", field="commodity", account="expenses:brand"),
    rules.Rule("first-line", "*", meta="SRC:line:1", account="expenses:first"),
]


@query(
    """, r AS (SELECT l_orderkey, l_linenumber, CASE WHEN sgn * qty >= 45 THEN 'large' WHEN narration LIKE '1-%' OR narration LIKE '2-%' THEN 'urgent'
    WHEN LOWER(commodity) LIKE 'brand\\_3%' ESCAPE '\\' THEN 'brand' WHEN l_linenumber = 1 THEN 'first-line' END AS rule_id FROM line)
    SELECT *, CASE rule_id WHEN 'large' THEN 'income:large' WHEN 'urgent' THEN 'expenses:urgent' WHEN 'brand' THEN 'expenses:brand'
    WHEN 'first-line' THEN 'expenses:first' ELSE 'expenses:unknown' END AS contra FROM r"""
)
def rule_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.first_match(ledger.transactions(spark, sf_dir), RULES).select(*KEY, "rule_id", "contra")


@query("SELECT l_orderkey, l_linenumber, p.price AS price, p.quote AS quote FROM line ASOF LEFT JOIN price p ON line.commodity = p.commodity AND line.date >= p.date")
def price_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prices.as_of(ledger.lines(spark, sf_dir), ledger.prices(spark, sf_dir), "commodity", "date", "p")
    return found.select(*KEY, "p.price", "p.quote")


@query(
    """, one AS (SELECT line.*, p.price AS p1, p.quote AS q1 FROM line ASOF LEFT JOIN price p ON line.commodity = p.commodity AND line.date >= p.date),
    two AS (SELECT one.*, p.price AS p2, p.quote AS q2 FROM one ASOF LEFT JOIN price p ON one.q1 = p.commodity AND one.date >= p.date)
    SELECT l_orderkey, l_linenumber, CASE WHEN q1 = 'AUD' THEN qty * p1 WHEN q2 = 'AUD' THEN qty * p1 * p2 END AS value FROM two"""
)
def convert_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prices.convert(ledger.lines(spark, sf_dir), ledger.prices(spark, sf_dir), "AUD", amount="qty")
    return found.select(*KEY, "value")


@query(
    """, one AS (SELECT line.*, p.quote AS q1 FROM line ASOF LEFT JOIN price p ON line.commodity = p.commodity AND line.date >= p.date)
    SELECT commodity, COUNT(*) AS n, MIN(date) AS first_date, MAX(date) AS last_date FROM one WHERE q1 IS NULL GROUP BY 1"""
)
def unpriced(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prices.as_of(ledger.lines(spark, sf_dir), ledger.prices(spark, sf_dir), "commodity", "date", "p").where("p is null")
    return found.groupBy("commodity").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(
    f""", b AS (SELECT account, commodity, {_SUM} AS amount FROM posting WHERE account LIKE 'assets:%' GROUP BY 1, 2),
    l AS (SELECT commodity, arg_max(price, date) AS price FROM price GROUP BY 1)
    SELECT account, commodity, amount, ABS(amount) * price AS value FROM b JOIN l USING (commodity) WHERE ABS(amount) * price >= 500000"""
)
def min_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = B.balances(ledger.postings(ledger.transactions(spark, sf_dir)).where(F.col("account").startswith("assets:")))
    value = F.abs("amount") * F.col("price")
    return held.join(prices.latest(ledger.prices(spark, sf_dir)), "commodity").select("account", "commodity", "amount", value.alias("value")).where("value >= 500000")


LOTS_SQL = """, e AS (SELECT commodity, date, l_orderkey, l_linenumber, sgn * qty AS q, net,
  SUM(CASE WHEN sgn > 0 THEN qty ELSE 0 END) OVER w AS a, SUM(CASE WHEN sgn < 0 THEN qty ELSE 0 END) OVER w AS c FROM line
  WINDOW w AS (PARTITION BY commodity ORDER BY date, l_orderkey, l_linenumber, sgn * qty, net ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, c - GREATEST(0, MAX(c - a) OVER (PARTITION BY commodity ORDER BY date, l_orderkey, l_linenumber, q, net ROWS UNBOUNDED PRECEDING)) AS d FROM e),
g AS (SELECT *, COALESCE(LAG(d) OVER (PARTITION BY commodity ORDER BY date, l_orderkey, l_linenumber, q, net), 0) AS d0 FROM f),
m AS (SELECT s.commodity, s.date AS sell_date, s.l_orderkey AS sell_order, s.l_linenumber AS sell_line, b.date AS buy_date, b.l_orderkey AS buy_order, b.l_linenumber AS buy_line,
  LEAST(s.d, b.a) - GREATEST(s.d0, b.a - b.q) AS taken, b.net AS buy_net, b.q AS buy_q, s.net AS sell_net, -s.q AS sell_q
  FROM g s JOIN g b ON s.commodity = b.commodity AND s.q < 0 AND b.q > 0 AND s.d > b.a - b.q AND b.a > s.d0),
t AS (SELECT *, buy_net * taken / buy_q AS cost, sell_net * taken / sell_q AS proceeds FROM m WHERE taken > 1e-10)"""


def lot_events(spark: SparkSession, sf_dir: str, pool: Column | None = None) -> DataFrame:
    """What was bought and sold, by commodity or by what else is one pool of lots."""
    line = ledger.lines(spark, sf_dir)
    return line.select(F.col("commodity") if pool is None else pool.alias("commodity"), "date", *KEY, (F.col("sgn") * F.col("qty")).alias("quantity"), F.col("net").alias("value"))


def _matches(spark: SparkSession, sf_dir: str, within: tuple[str, str] | None = None) -> DataFrame:
    return lots.gains(lots.match(lot_events(spark, sf_dir), [*KEY, "quantity", "value"], within))


@query(
    f"""{LOTS_SQL}, every AS (SELECT commodity, sell_date, sell_order, sell_line, buy_date, buy_order, buy_line, taken AS quantity, cost, proceeds FROM t
      UNION ALL SELECT commodity, date, l_orderkey, l_linenumber, NULL, NULL, NULL, -q - (d - d0), 0, net * (-q - (d - d0)) / -q FROM g WHERE q < 0 AND -q - (d - d0) > 1e-10 AND commodity IS NOT NULL)
    SELECT commodity, sell_date, sell_order, sell_line, buy_date, buy_order, buy_line, quantity, cost, proceeds, proceeds - cost AS gain,
    COALESCE(proceeds - cost > 0 AND (CAST(SUBSTRING(sell_date, 1, 4) AS INT) - CAST(SUBSTRING(buy_date, 1, 4) AS INT)) * 12 + CAST(SUBSTRING(sell_date, 6, 2) AS INT)
    - CAST(SUBSTRING(buy_date, 6, 2) AS INT) - CASE WHEN SUBSTRING(sell_date, 9, 2) < SUBSTRING(buy_date, 9, 2) THEN 1 ELSE 0 END >= 12, FALSE) AS discount_eligible
    FROM every WHERE sell_date BETWEEN '1996-07-01' AND '1997-06-30'"""
)
def cgt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of a financial year. What was sold beyond the holding is an event without a lot, which cost nothing."""
    found = report_lines.gain_events(lot_events(spark, sf_dir), [*KEY, "quantity", "value"], "1996-07-01", "1997-06-30")
    return found.select(
        "commodity", F.col("sale.date").alias("sell_date"), F.col("sale.l_orderkey").alias("sell_order"), F.col("sale.l_linenumber").alias("sell_line"),
        F.col("lot.date").alias("buy_date"), F.col("lot.l_orderkey").alias("buy_order"), F.col("lot.l_linenumber").alias("buy_line"),
        "quantity", "cost", "proceeds", "gain", F.col("eligible").alias("discount_eligible"),
    )


@query(
    f"""{LOTS_SQL} SELECT CAST(SUBSTRING(sell_date, 1, 4) AS INT) + CASE WHEN SUBSTRING(sell_date, 6, 5) > '06-30' THEN 1 ELSE 0 END AS fy, COUNT(*) AS n,
    ROUND(SUM(cost), 2) AS cost, ROUND(SUM(proceeds), 2) AS proceeds FROM t GROUP BY 1"""
)
def cgt_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("sale.date")
    fy = F.substring(day, 1, 4).cast("int") + (F.substring(day, 6, 5) > "06-30").cast("int")
    money = lambda c: F.round(F.sum(c), 2).alias(c)
    return _matches(spark, sf_dir).groupBy(fy.alias("fy")).agg(F.count("*").alias("n"), money("cost"), money("proceeds"))


@query(
    """, a AS (SELECT l_orderkey, l_linenumber, date, account, commodity, amount FROM posting WHERE pos = 0),
    b AS (SELECT *, CASE WHEN LAG(date) OVER w = date AND LAG(commodity) OVER w = commodity THEN 0 ELSE 1 END AS brk FROM a WINDOW w AS (PARTITION BY account ORDER BY date, l_orderkey, l_linenumber, commodity, amount)),
    c AS (SELECT *, SUM(brk) OVER (PARTITION BY account ORDER BY date, l_orderkey, l_linenumber, commodity, amount ROWS UNBOUNDED PRECEDING) AS run FROM b)
    SELECT account, CAST(run AS BIGINT) AS run, MIN(date) AS date, MIN(commodity) AS commodity, COUNT(*) AS n, CAST(SUM(CAST(GREATEST(amount, 0) AS DECIMAL(24,6))) AS DOUBLE) AS total_in,
    CAST(SUM(CAST(LEAST(amount, 0) AS DECIMAL(24,6))) AS DOUBLE) AS total_out, CAST(SUM(CAST(amount AS DECIMAL(24,6))) AS DOUBLE) AS net FROM c GROUP BY 1, 2"""
)
def tx_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.display_groups(ledger.postings(ledger.transactions(spark, sf_dir)).where("pos = 0"))


@query("SELECT l_orderkey, l_linenumber, date, payee FROM line ORDER BY date DESC, l_orderkey, l_linenumber LIMIT 200 OFFSET 100")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.lines(spark, sf_dir).select(*KEY, "date", "payee")
    return rows.orderBy(F.desc("date"), *KEY).offset(100).limit(200)


@query("SELECT account, COUNT(*) AS n FROM posting WHERE account LIKE 'income:%' OR account LIKE 'expenses:%' GROUP BY 1")
def report_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.postings(ledger.transactions(spark, sf_dir))
    return rows.where(F.col("account").startswith("income:") | F.col("account").startswith("expenses:")).groupBy("account").agg(F.count("*").alias("n"))


@query(
    """SELECT date_trunc('day', ts) AS day, event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(24,6))) AS DOUBLE) AS total
    FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY 1, 2"""
)
def event_daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.daily_totals(spark.read.parquet(f"{sf_dir}/events.parquet"))
