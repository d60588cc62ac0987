"""The driver's star schema read as a double-entry ledger: transactions, postings and prices.

A line of an order is a transaction, its order the shared `txn:` id, a returned line a disposal and a brand a commodity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "part", "orders", "lineitem")

LINE_SQL = """
SELECT 'o' || CAST(l.l_orderkey AS STRING) AS oid, l.l_orderkey, l.l_linenumber, SUBSTRING(CAST(o.o_orderdate AS STRING), 1, 10) AS date,
       c.c_name AS payee, o.o_orderpriority AS narration, CASE o.o_orderstatus WHEN 'F' THEN '*' WHEN 'P' THEN '!' END AS status,
       'txn:o' || CAST(l.l_orderkey AS STRING) || ', src:line:' || CAST(l.l_linenumber AS STRING) AS meta,
       'assets:' || LOWER(REPLACE(r.r_name, ' ', '_')) || ':' || LOWER(REPLACE(n.n_name, ' ', '_')) AS account, REPLACE(p.p_brand, '#', '_') AS commodity,
       CASE WHEN l.l_returnflag = 'R' THEN -1 ELSE 1 END AS sgn, l.l_quantity AS qty,
       FLOOR(l.l_extendedprice * (1 - l.l_discount) * 100) / 100 AS net, FLOOR(l.l_extendedprice * l.l_tax * 100) / 100 AS fee
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey JOIN {part} p ON l.l_partkey = p.p_partkey
"""

PRICE_SQL = """
SELECT REPLACE(p.p_brand, '#', '_') AS commodity, SUBSTRING(CAST(DATE_TRUNC('month', l.l_shipdate) AS STRING), 1, 10) AS date,
       MAX(l.l_extendedprice / l.l_quantity) AS price, 'USD' AS quote
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey GROUP BY 1, 2
UNION ALL SELECT 'USD', d, 1.25 + 0.01 * m, 'AUD'
FROM (SELECT DISTINCT SUBSTRING(CAST(DATE_TRUNC('month', o_orderdate) AS STRING), 1, 10) AS d, CAST(EXTRACT(MONTH FROM o_orderdate) AS DOUBLE) AS m FROM {orders}) x
"""

_TRADE_SQL = """
SELECT REPLACE(p.p_brand, '#', '_') AS commodity, o.date, l.l_orderkey, l.l_linenumber, CASE WHEN l.l_returnflag = 'R' THEN -1 ELSE 1 END * l.l_quantity AS quantity,
       FLOOR(l.l_extendedprice * (1 - l.l_discount) * 100) / 100 AS value
FROM {lineitem} l JOIN (
  SELECT o_orderkey, SUBSTRING(CAST(o_orderdate AS STRING), 1, 10) AS date FROM {orders} JOIN {customer} ON o_custkey = c_custkey
  JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
) o ON l.l_orderkey = o.o_orderkey JOIN {part} p ON l.l_partkey = p.p_partkey
"""

_NAMES = {t: t for t in TABLES}
#: Common table expressions for the SQL of the queries.
SQL_WITH = f"""line AS ({LINE_SQL.format(**_NAMES)}),
posting AS (
  SELECT l_orderkey, l_linenumber, 0 AS pos, date, status, payee, narration, meta, account, CAST(sgn * qty AS DOUBLE) AS amount, commodity FROM line
  UNION ALL SELECT l_orderkey, l_linenumber, 1, date, status, payee, narration, meta, CASE WHEN sgn < 0 THEN 'equity:trading:sell' ELSE 'equity:trading:buy' END, -sgn * net, 'USD' FROM line
  UNION ALL SELECT l_orderkey, l_linenumber, 2, date, status, payee, narration, meta, 'expenses:fees:trading', fee, 'USD' FROM line WHERE fee > 0),
price AS ({PRICE_SQL.format(**_NAMES)})"""


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LINE_SQL, **_tables(spark, sf_dir))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commodity, date, keys, quantity and value of lines(). Orders meet their customers before their lines do, so far fewer rows are shuffled for these."""
    return spark.sql(_TRADE_SQL, **_tables(spark, sf_dir))


def commodities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All commodities that a line may have."""
    return spark.sql("SELECT DISTINCT REPLACE(p_brand, '#', '_') AS commodity FROM {part}", part=_tables(spark, sf_dir)["part"])


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per transaction, with its postings as an array in order; no shuffle beyond the joins."""

    def posting(pos: int, account, amount, commodity):
        return F.struct(F.lit(pos).alias("pos"), account.alias("account"), amount.cast("double").alias("amount"), commodity.alias("commodity"))

    sgn = F.col("sgn")
    counter = F.when(sgn < 0, F.lit("equity:trading:sell")).otherwise(F.lit("equity:trading:buy"))
    legs = F.array(
        posting(0, F.col("account"), sgn * F.col("qty"), F.col("commodity")),
        posting(1, counter, -sgn * F.col("net"), F.lit("USD")),
        F.when(F.col("fee") > 0, posting(2, F.lit("expenses:fees:trading"), F.col("fee"), F.lit("USD"))),
    )
    own = ["l_orderkey", "l_linenumber", "oid", "date", "status", "payee", "narration", "meta"]
    return lines(spark, sf_dir).select(*own, F.filter(legs, lambda p: p.isNotNull()).alias("postings"))


def postings(txns: DataFrame) -> DataFrame:
    own = [c for c in txns.columns if c not in ("postings", "oid")]
    return txns.select(*own, F.explode("postings").alias("p")).select(*own, "p.*")


def sums_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account, commodity, amount), summed by account, commodity and side of lines before the legs that these stand for are made, so a posting is never a row.

    Amounts are decimals; an account and commodity may have several rows.
    """
    exact = lambda c: F.sum(F.col(c).cast("decimal(24,6)")).alias(c)
    fees = lines(spark, sf_dir).withColumn("fee", F.when(F.col("fee") > 0, F.col("fee")))
    sums = fees.groupBy("account", "commodity", "sgn").agg(exact("qty"), exact("net"), exact("fee"))
    sgn = F.col("sgn")

    def leg(account, amount, commodity):
        return F.struct(account.alias("account"), amount.cast("decimal(34,6)").alias("amount"), commodity.alias("commodity"))

    counter = F.when(sgn < 0, F.lit("equity:trading:sell")).otherwise(F.lit("equity:trading:buy"))
    legs = F.array(
        leg(F.col("account"), sgn * F.col("qty"), F.col("commodity")), leg(counter, -sgn * F.col("net"), F.lit("USD")),
        F.when(F.col("fee").isNotNull(), leg(F.lit("expenses:fees:trading"), F.col("fee"), F.lit("USD"))),
    )
    return sums.select(F.explode(F.filter(legs, lambda p: p.isNotNull())).alias("p")).select("p.*")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PRICE_SQL, **_tables(spark, sf_dir))
