"""Folders, edits, doubles, sources of prices, chain records and losses over years, on the driver's tables; each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pennyworks.functions import formats
from pennyworks.operators import chain_records, edits, files, folders, prices, valuation
from pennyworks.plans import catalog, ledger
from pennyworks.plans.catalog import KEY, query
from pennyworks.sources import manual
from pennyworks.sources.ledger_text import price_lines
from pennyworks.sources.scratch import folder

#: Mappings and rules at folders of several depths: every region has rules, two nations mappings and rules of their own.
SPEC_SQL = """SELECT DISTINCT SUBSTRING_INDEX(account, ':', 2) AS path, 'region' AS spec FROM {line} WHERE account < 'assets:b' OR account > 'assets:e'
    UNION ALL SELECT DISTINCT account, 'nation ' || SUBSTRING(account, -1, 1) FROM {line} WHERE account LIKE '%2' OR account LIKE '%7' UNION ALL SELECT 'assets', 'all'"""
_SPEC = SPEC_SQL.format(line="line").replace("SUBSTRING_INDEX(account, ':', 2)", "regexp_extract(account, '^[^:]*:[^:]*')").replace("SUBSTRING(account, -1, 1)", "right(account, 1)")


@query(f""", spec AS ({_SPEC}), f AS (SELECT DISTINCT account AS folder FROM line)
    SELECT folder, path, spec FROM f JOIN spec ON folder = path OR starts_with(folder, path || ':') QUALIFY ROW_NUMBER() OVER (PARTITION BY folder ORDER BY LENGTH(path) DESC) = 1""")
def nearest_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = ledger.lines(spark, sf_dir)
    return folders.nearest(line.select(F.col("account").alias("folder")), spark.sql(SPEC_SQL, line=line))


@query(f""", spec AS ({_SPEC}), rule AS (SELECT path, k AS ord, spec || ' ' || k AS rule FROM spec, range(1, 4) t(k)), f AS (SELECT DISTINCT account AS folder FROM line)
    SELECT folder, ROW_NUMBER() OVER (PARTITION BY folder ORDER BY LENGTH(path) DESC, ord) AS place, path, ord, rule FROM f JOIN rule ON folder = path OR starts_with(folder, path || ':')""")
def rules_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = ledger.lines(spark, sf_dir)
    three = spark.sql(SPEC_SQL, line=line).select("path", "spec", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("ord"))
    rules = three.select("path", "ord", F.concat_ws(" ", "spec", F.col("ord").cast("string")).alias("rule"))
    found = folders.rules_chain(line.select(F.col("account").alias("folder")), rules)
    return found.withColumn("place", F.col("place").cast("long"))


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, CASE WHEN event_type <> 'view' THEN value END AS amount, CASE WHEN event_type <> 'click' THEN event_type END AS kind FROM events),
    gone AS (SELECT user_id, arg_max((ts, event_id), (ts, event_id)) AS at FROM e WHERE op = 'delete' GROUP BY 1),
    alive AS (SELECT e.* FROM e LEFT JOIN gone USING (user_id) WHERE op = 'put' AND (gone.at IS NULL OR (e.ts, e.event_id) > gone.at))
    SELECT user_id, arg_max(amount, (ts, event_id)) FILTER (amount IS NOT NULL) AS amount, arg_max(kind, (ts, event_id)) FILTER (kind IS NOT NULL) AS kind, MIN(ts) AS place_ts, arg_min(event_id, (ts, event_id)) AS place_event_id FROM alive GROUP BY 1""")
def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits of users: errors delete, views know no amount, clicks no kind."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = events.select(
        "user_id", "ts", "event_id", F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("amount"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"),
    )
    return edits.state(log, "user_id", ["ts", "event_id"], ["amount", "kind"])


_FILES = """d AS (SELECT account AS folder, narration AS file, CAST(date AS DATE) AS day, CAST(qty AS DOUBLE) AS size, payee || ' ' || commodity AS key, l_orderkey, l_linenumber FROM line),
    s AS (SELECT folder, file, MAX(day) - MIN(day) AS days, MAX(size) AS size FROM d GROUP BY 1, 2),
    b AS (SELECT folder, key, file AS winner FROM (SELECT DISTINCT folder, key, file FROM d) JOIN s USING (folder, file) QUALIFY ROW_NUMBER() OVER (PARTITION BY folder, key ORDER BY days DESC, size DESC, file) = 1),
    m AS (SELECT d.*, winner <> file AS dropped FROM d JOIN b USING (folder, key))"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = ledger.lines(spark, sf_dir)
    return line.select(F.col("account").alias("folder"), F.col("narration").alias("file"), F.col("date").alias("day"), F.col("qty").cast("double").alias("size"), F.concat_ws(" ", "payee", "commodity").alias("key"), *KEY)


@query(f", {_FILES} SELECT folder, file, key, l_orderkey, l_linenumber FROM m WHERE NOT dropped")
def dedupe_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.deduplicated(_files(spark, sf_dir))[0].select("folder", "file", "key", *KEY)


@query(f", {_FILES} SELECT folder, file, COUNT(*) AS rows, CAST(SUM(CAST(dropped AS INT)) AS BIGINT) AS dropped, SUM(CAST(dropped AS INT)) = COUNT(*) AS archived FROM m GROUP BY 1, 2")
def dedupe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.deduplicated(_files(spark, sf_dir))[1]


_QUOTES = """q AS (SELECT commodity, CASE l_linenumber % 3 WHEN 0 THEN 'spot' WHEN 1 THEN 'daily' ELSE 'weekly' END AS source, date FROM line WHERE l_linenumber % 3 = 2 OR qty >= 47),
    src AS (SELECT DISTINCT commodity, source, CASE source WHEN 'spot' THEN 1 WHEN 'daily' THEN 2 ELSE 3 END AS ord FROM q),
    n AS (SELECT commodity, source, MAX(date) AS last FROM q GROUP BY 1, 2)"""


@query(f", {_QUOTES} SELECT commodity, source, last FROM src JOIN n USING (commodity, source) WHERE date_diff('day', CAST(last AS DATE), DATE '1998-08-05') <= 9 QUALIFY ROW_NUMBER() OVER (PARTITION BY commodity ORDER BY ord) = 1")
def first_fresh_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large lines of two sources that are often stale, and all lines of a third."""
    line, k = ledger.lines(spark, sf_dir), F.col("l_linenumber") % 3
    quotes = line.where((k == 2) | (F.col("qty") >= 47)).select("commodity", F.when(k == 0, "spot").when(k == 1, "daily").otherwise("weekly").alias("source"), "date")
    order = F.when(F.col("source") == "spot", 1).when(F.col("source") == "daily", 2).otherwise(3)
    return prices.first_fresh(quotes, quotes.select("commodity", "source").distinct().withColumn("ord", order), "1998-08-05", 9)


@query("SELECT commodity, date, FLOOR((CASE WHEN commodity LIKE '%2' AND date > '1995' THEN 2 * price ELSE price END) * 1e6 + 0.5) / 1e6 AS price, quote FROM price")
def price_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prices written to files by commodity, some commodities' later ones put in again at twice the price, and every file read back."""
    quotes, path = ledger.prices(spark, sf_dir).withColumn("price", F.col("price").cast("double")), folder(spark, "price-files")
    prices.write_files(quotes, path)
    prices.upsert(spark, quotes.where("commodity like '%2' and date > '1995'").withColumn("price", F.col("price") * 2), path)
    found = price_lines(spark.read.text(path).select("value"))
    return found.select("commodity", "date", (F.floor(F.col("price") * 1e6 + 0.5) / 1e6).alias("price"), "quote")


_YEARS = """yg AS (SELECT commodity AS key, CAST(SUBSTRING(sell_date, 1, 4) AS INT) + CASE WHEN SUBSTRING(sell_date, 6, 5) > '06-30' THEN 1 ELSE 0 END AS fy,
      CAST(proceeds - cost AS DOUBLE) - 15000 AS gain, (CAST(SUBSTRING(sell_date, 1, 4) AS INT) - CAST(SUBSTRING(buy_date, 1, 4) AS INT)) * 12 + CAST(SUBSTRING(sell_date, 6, 2) AS INT)
      - CAST(SUBSTRING(buy_date, 6, 2) AS INT) - CASE WHEN SUBSTRING(sell_date, 9, 2) < SUBSTRING(buy_date, 9, 2) THEN 1 ELSE 0 END >= 12 AS held FROM t),
    y AS (SELECT key, fy, SUM(CASE WHEN gain > 0 AND NOT held THEN gain ELSE 0 END) AS short, SUM(CASE WHEN gain > 0 AND held THEN gain ELSE 0 END) AS long, SUM(CASE WHEN gain < 0 THEN -gain ELSE 0 END) AS losses FROM yg GROUP BY 1, 2)"""


@query(f"""{catalog.LOTS_SQL}, {_YEARS}, c1 AS (SELECT *, SUM(losses - short - long) OVER (PARTITION BY key ORDER BY fy) AS s FROM y),
    c2 AS (SELECT *, s - LEAST(0, MIN(s) OVER (PARTITION BY key ORDER BY fy)) AS left_over FROM c1), c AS (SELECT *, COALESCE(LAG(left_over) OVER (PARTITION BY key ORDER BY fy), 0) AS before FROM c2)
    SELECT key, fy, ROUND(GREATEST(short - losses - before, 0) + (long - LEAST(long, GREATEST(losses + before - short, 0))) * 0.5, 2) AS taxable,
      ROUND(LEAST(losses + before, short + long), 2) AS used, ROUND(left_over, 2) AS carried FROM c""")
def loss_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains less a charge that makes many of them losses, by commodity and financial year, with what is carried on."""
    from pennyworks.operators import lots

    found = catalog._matches(spark, sf_dir)
    day, gain = F.col("sale.date"), F.col("gain") - 15000
    long = lots.whole_months(F.col("lot.date"), day) >= 12
    fy = F.substring(day, 1, 4).cast("int") + (F.substring(day, 6, 5) > "06-30").cast("int")
    total = lambda when, x: F.sum(F.when(when, x).otherwise(0.0))
    years = found.groupBy(F.col("commodity").alias("key"), fy.alias("fy")).agg(
        total((gain > 0) & ~long, gain).alias("short"), total((gain > 0) & long, gain).alias("long"), total(gain < 0, -gain).alias("losses"),
    )
    return valuation.loss_carry(years, 0.5).select("key", "fy", *(F.round(c, 2).alias(c) for c in ("taxable", "used", "carried")))


_RECORDS = """r AS (SELECT oid AS tx, payee AS wallet, CASE WHEN l_linenumber IN (1, 4) THEN 'COIN' ELSE commodity END AS asset, CASE WHEN l_linenumber <> 1 AND status = '*' THEN commodity END AS contract,
      account AS sender, payee AS receiver, CAST(qty AS BIGINT) AS value, CASE WHEN sgn < 0 THEN 'out' ELSE 'in' END AS direction, l_linenumber AS n FROM line)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {_RECORDS} SELECT * FROM r".replace("FROM line", "FROM {line}"), line=ledger.lines(spark, sf_dir))


@query(f""", {_RECORDS}, closed AS (SELECT DISTINCT tx, sender, wallet FROM r WHERE n = 2 AND value > 20),
    kept AS (SELECT r.* FROM r WHERE NOT (asset = 'COIN' AND contract IS NULL AND EXISTS (SELECT 1 FROM closed c WHERE c.tx = r.tx AND c.sender = r.sender AND c.wallet = r.wallet))),
    base AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tx, asset, value, direction ORDER BY n, sender, contract NULLS FIRST) AS k FROM kept WHERE n <= 3),
    extra AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tx, asset, value, direction ORDER BY n, sender, contract NULLS FIRST) AS k FROM r WHERE n >= 3),
    al AS (SELECT tx, asset, value, direction, COUNT(*) AS c FROM base GROUP BY ALL), ex AS (SELECT tx, asset, value, direction, COUNT(*) AS c, MIN(contract) AS more FROM extra GROUP BY ALL),
    rich AS (SELECT b.tx, b.asset, COALESCE(b.contract, CASE WHEN al.c = 1 AND ex.c = 1 THEN more END) AS contract, b.value, b.direction, b.n FROM base b JOIN al USING (tx, asset, value, direction) LEFT JOIN ex USING (tx, asset, value, direction))
    SELECT * FROM rich UNION ALL SELECT tx, asset, contract, value, direction, n FROM extra e WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.tx = e.tx AND b.asset = e.asset AND b.value = e.value AND b.direction = e.direction AND b.k = e.k)""")
def chain_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of orders as records, later ones as a second source of them; accounts of large second lines are closed."""
    records = _records(spark, sf_dir)
    closes = records.where("n = 2 and value > 20").select("tx", F.col("sender").alias("account"), F.col("wallet").alias("owner"), F.col("wallet").alias("destination"))
    held = records.where("n = 2").select("tx", F.col("sender").alias("account"), F.lit("WRAPPED").alias("mint"))
    kept = chain_records.without_closes(records, closes, held, "COIN", "WRAPPED")
    base, extra = kept.where("n <= 3"), records.where("n >= 3")
    found = chain_records.merged(chain_records.enriched(base, extra, ["contract"]), extra, ["n", "sender", "contract"])
    return found.select("tx", "asset", "contract", "value", "direction", "n")


@query("""SELECT l_orderkey, l_linenumber, printf('%.2f', net) AS fixed, format('{:,.2f}', CAST(net AS DOUBLE)) AS money,
    CASE WHEN qty >= 10 THEN printf('%.6f', qty / 1000000) ELSE printf('%.7f', qty / 1000000) END AS small FROM line WHERE qty <> 10""")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.lines(spark, sf_dir).where("qty <> 10")
    small = formats.smart(F.col("qty") / 1000000)
    return rows.select(*KEY, formats.smart(F.col("net").cast("double")).alias("fixed"), formats.money(F.col("net").cast("double")).alias("money"), small.alias("small"))


@query("""SELECT l_orderkey, l_linenumber, meta FROM line WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT 'o' || l_orderkey || CASE WHEN l_orderkey % 2 = 0 THEN ', src:line:3' ELSE '' END AS id FROM line WHERE l_orderkey % 97 = 0) i
    WHERE contains(line.meta, i.id))""")
def ignored_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some orders left out as a whole (with all whose number begins like theirs), of others the third line."""
    line = ledger.lines(spark, sf_dir)
    tail = F.when(F.col("l_orderkey") % 2 == 0, ", src:line:3").otherwise("")
    return manual.without_ignored(line.select(*KEY, "meta"), line.where("l_orderkey % 97 = 0").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), tail).alias("id")))
