"""Partners of swaps, attribution of gains and CSV rows on the driver's tables; SQL where it can tell the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pennyworks.operators import balances as B
from pennyworks.operators import issues, partners, prices, reports
from pennyworks.plans import catalog, ledger
from pennyworks.plans.catalog import KEY, query
from pennyworks.plans.report_queries import END, START
from pennyworks.sources import csv_rows
from pennyworks.sources.scratch import written


@query(""", t AS (SELECT date, account, CASE WHEN sgn < 0 THEN 'sell' ELSE 'buy' END AS side, commodity, l_orderkey, CAST(SUM(CAST(qty AS DECIMAL(24,6))) AS DOUBLE) AS total FROM line GROUP BY ALL),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY date, account, side, commodity ORDER BY total, l_orderkey) AS k FROM t)
    SELECT a.date, a.account, a.side, a.commodity, a.l_orderkey, a.total, MAX(b.commodity) AS partner, arg_max(b.l_orderkey, b.commodity) AS partner_order,
      FLOOR(arg_max(b.total, b.commodity) / a.total * 1e4) / 1e4 AS unit
    FROM r a JOIN r b ON a.date = b.date AND a.account = b.account AND a.side <> b.side AND a.k = b.k AND a.commodity <> b.commodity GROUP BY 1, 2, 3, 4, 5, 6""")
def swap_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = ledger.lines(spark, sf_dir).withColumn("amount", F.col("sgn") * F.col("qty"))
    found = partners.pooled_swaps(legs, ["date", "account"], ["l_orderkey"])
    unit = (F.floor(F.col("unit") * 1e4) / 1e4).alias("unit")
    return found.select("date", "account", "side", "commodity", "l_orderkey", "total", F.col("partner.commodity").alias("partner"), F.col("partner.l_orderkey").alias("partner_order"), unit)


@query(""", x AS (SELECT *, CASE WHEN sgn < 0 THEN 'sell' ELSE 'buy' END AS side, oid || ':' || l_linenumber AS id, CASE WHEN l_linenumber = 7 THEN oid || ':1' END AS ref,
      ROW_NUMBER() OVER (ORDER BY l_orderkey, l_linenumber, commodity, qty, net) AS rn FROM line),
    p AS (SELECT a.rn, COUNT(*) FILTER (b.side = a.side AND b.commodity = a.commodity) AS n,
      COUNT(*) FILTER (b.side = a.side AND b.commodity = a.commodity AND (b.qty < a.qty OR (b.qty = a.qty AND b.rn <= a.rn))) AS k,
      list(b.rn ORDER BY b.qty, b.rn) FILTER (b.side <> a.side) AS others, MIN(b.rn) FILTER (b.side <> a.side) AS first_other, COUNT(*) FILTER (b.commodity = a.commodity) AS m,
      COUNT(*) FILTER (b.commodity = a.commodity AND (b.qty < a.qty OR (b.qty = a.qty AND b.rn <= a.rn))) AS j,
      list(b.rn ORDER BY b.qty, b.rn) FILTER (b.commodity <> a.commodity) AS rest, MIN(b.rn) FILTER (b.commodity <> a.commodity) AS first_rest
      FROM x a JOIN x b USING (date, narration) GROUP BY 1),
    s AS (SELECT x.*, COALESCE(named.rn, CASE WHEN n > 1 AND n = len(others) THEN others[k] END, first_other, CASE WHEN m > 1 AND m = len(rest) THEN rest[j] END, first_rest) AS found
      FROM x JOIN p USING (rn) LEFT JOIN (SELECT id AS ref, MIN(rn) AS rn FROM x GROUP BY 1) named ON named.ref = x.ref)
    SELECT s.l_orderkey, s.l_linenumber, s.commodity, y.l_orderkey AS sibling_order, y.l_linenumber AS sibling_line FROM s LEFT JOIN x y ON y.rn = s.found""")
def swap_sibling(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat_ws(":", "oid", "l_linenumber")
    legs = ledger.lines(spark, sf_dir).select(
        "date", "narration", *KEY, "commodity", "qty", "net", F.when(F.col("sgn") < 0, "sell").otherwise("buy").alias("side"), F.col("qty").alias("size"),
        own.alias("id"), F.when(F.col("l_linenumber") == 7, F.concat("oid", F.lit(":1"))).alias("ref"),
    )
    found = partners.siblings(legs, ["date", "narration"], [*KEY, "commodity", "qty", "net"], [*KEY, "commodity"])
    return found.select(*KEY, "commodity", F.col("sibling.l_orderkey").alias("sibling_order"), F.col("sibling.l_linenumber").alias("sibling_line"))


#: Legs by day with their value in base, and what each would take first: a payee's before others, earlier ones before later ones.
#: `fits` says which legs are one group, `near` which of them go together. The walk over a group's legs is a recursion that remembers the legs that are used.
_GREEDY_SQL = """, leg AS (SELECT oid || ':' || l_linenumber || ':' || commodity || ':' || qty || ':' || net AS id, * FROM line),
    one AS (SELECT leg.*, p.price AS p1, p.quote AS q1 FROM leg ASOF LEFT JOIN price p ON leg.commodity = p.commodity AND leg.date >= p.date),
    worth AS (SELECT one.*, CASE q1 WHEN 'AUD' THEN qty * p1 ELSE CASE WHEN p.quote = 'AUD' THEN qty * p1 * p.price END END AS v FROM one ASOF LEFT JOIN price p ON one.q1 = p.commodity AND one.date >= p.date),
    x AS (SELECT {group} AS g, *, CAST(ROW_NUMBER() OVER (PARTITION BY {group} ORDER BY l_orderkey, l_linenumber, id) AS INT) AS i FROM worth),
    cand AS (SELECT a.g, a.i, list(b.i ORDER BY CASE WHEN a.payee = b.payee THEN 0 ELSE 1 END, b.i) AS js,
      list(COALESCE(GREATEST(a.v, b.v) > 0 AND LEAST(a.v, b.v) / GREATEST(a.v, b.v) < 0.2, FALSE) ORDER BY CASE WHEN a.payee = b.payee THEN 0 ELSE 1 END, b.i) AS far
      FROM x a JOIN x b ON a.g = b.g AND a.i < b.i AND a.commodity <> b.commodity AND {near} GROUP BY 1, 2)
    SELECT {shown} FROM (WITH RECURSIVE
      size AS (SELECT g, MAX(i) AS n FROM x GROUP BY 1),
      walk AS (SELECT g, 0 AS i, n, CAST([] AS INT[]) AS used, NULL::INT AS took FROM size
        UNION ALL SELECT g, i, n, CASE WHEN took IS NULL THEN used ELSE list_concat(used, [took]) END, took FROM
        (SELECT g, i, n, used, CASE WHEN list_contains(used, i) OR far[list_position(js, best)] THEN NULL ELSE best END AS took FROM
        (SELECT w.g, w.i + 1 AS i, n, used, js, far, list_filter(js, lambda j: NOT list_contains(used, j))[1] AS best
        FROM walk w LEFT JOIN cand c ON c.g = w.g AND c.i = w.i + 1 WHERE w.i < n)))
      SELECT g, i, took FROM walk WHERE took IS NOT NULL) t JOIN x a ON a.g = t.g AND a.i = t.i JOIN x b ON b.g = t.g AND b.i = t.took"""


def suggestion_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First postings with their value in base; a day has no times, so all of an account's day is within the span."""
    line = ledger.lines(spark, sf_dir).withColumn("amount", F.col("sgn") * F.col("qty"))
    valued = prices.convert(line.drop("value"), ledger.prices(spark, sf_dir), "AUD", amount="qty")
    columns = [F.concat_ws(":", "oid", "l_linenumber", "commodity", F.col("qty").cast("string"), F.col("net").cast("string")).alias("id"), F.col("date").alias("at")]
    return valued.select("account", *columns, *KEY, "commodity", F.col("amount").cast("double").alias("amount"), "payee", F.lit(None).cast("string").alias("src"), "value", "narration")


_PAIR_SQL = "CASE WHEN a.sgn < 0 THEN a.id ELSE b.id END AS sell, CASE WHEN a.sgn < 0 THEN b.id ELSE a.id END AS buy"


@query(_GREEDY_SQL.format(shown=_PAIR_SQL, group="account || ':' || date", near="a.sgn <> b.sgn"))
def trade_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partners.suggest(suggestion_legs(spark, sf_dir).drop("narration"), [*KEY, "id"])


@query(_GREEDY_SQL.format(shown=_PAIR_SQL, group="date", near="((a.account = b.account AND a.sgn <> b.sgn) OR (a.narration = b.narration AND a.l_linenumber = b.l_linenumber))"))
def trade_suggest_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's lines of the same number and priority share a source, whatever their accounts."""
    src = F.concat_ws(":", "at", "narration", "l_linenumber")
    return partners.suggest(suggestion_legs(spark, sf_dir).withColumn("src", src), [*KEY, "id"])


_GIVEN = "CASE WHEN a.sgn < 0 THEN {0}.date || ' ' || CAST(CAST({0}.qty AS BIGINT) AS VARCHAR) || ' ' || {0}.commodity || ' → ' || CAST(CAST({1}.qty AS BIGINT) AS VARCHAR) || ' ' || {1}.commodity END"


@query(_GREEDY_SQL.format(shown=f"'Suggested Trades' AS label, 'info' AS severity, NULL AS account, COALESCE({_GIVEN.format('a', 'b')}, {_GIVEN.format('b', 'a').replace('a.sgn < 0', 'a.sgn > 0')}) AS message", group="account || ':' || date", near="a.sgn <> b.sgn"))
def suggestion_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = written(suggestion_legs(spark, sf_dir).drop("narration"), "legs")
    return issues.suggestion_messages(partners.suggest(legs, [*KEY, "id"]), legs)


@query(""", u AS (SELECT * FROM line WHERE l_linenumber = 1), m AS (SELECT DISTINCT account, date_trunc('month', CAST(date AS DATE)) AS m FROM line), b AS (SELECT account, MIN(m) AS lo, MAX(m) AS hi FROM m GROUP BY 1),
    d AS (SELECT account, UNNEST(generate_series(lo, hi, INTERVAL 1 MONTH)) AS m FROM b), known AS (SELECT * FROM price WHERE NOT (commodity LIKE 'Brand_4%' AND date < '1997-01-01')),
    one AS (SELECT line.*, p.quote AS q1 FROM line ASOF LEFT JOIN known p ON line.commodity = p.commodity AND line.date >= p.date),
    two AS (SELECT one.*, p.quote AS q2 FROM one ASOF LEFT JOIN known p ON one.q1 = p.commodity AND one.date >= p.date)
    SELECT 'Uncategorised' AS label, 'warning' AS severity, NULL AS account, COUNT(*) || ' uncategorised transaction' || CASE WHEN COUNT(*) = 1 THEN '' ELSE 's' END AS message FROM u HAVING COUNT(*) > 0
    UNION ALL SELECT 'Uncategorised', 'warning', NULL, date || ' ' || payee || ' — ' || narration FROM (SELECT * FROM u ORDER BY date, l_orderkey, l_linenumber, payee, narration LIMIT 10)
    UNION ALL SELECT 'Uncategorised', 'warning', NULL, '...and ' || (COUNT(*) - 10) || ' more' FROM u HAVING COUNT(*) > 10
    UNION ALL SELECT CASE WHEN l_linenumber = 2 THEN split_part(account, ':', 1) ELSE 'Other' END, 'warning', CASE WHEN l_linenumber = 2 THEN split_part(account, ':', 1) ELSE 'Other' END,
      CASE WHEN l_linenumber = 2 THEN substr(account, strpos(account, ':') + 1) || ': ' || narration ELSE narration END FROM line WHERE l_linenumber < 3
    UNION ALL SELECT account, 'info', account, 'Missing data for: ' || string_agg(strftime(d.m, '%Y%m'), ', ' ORDER BY d.m) FROM d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.account = d.account AND m.m = d.m) GROUP BY account
    UNION ALL SELECT 'Unverified Balance', 'info', NULL, account || ' — no opening balance' FROM (SELECT DISTINCT account FROM line WHERE account NOT IN (SELECT account FROM line WHERE commodity = 'Brand_11' AND qty > 49 AND sgn > 0))
    UNION ALL SELECT 'Unpriced', 'warning', NULL, commodity || ' — ' || COUNT(*) || ' postings, ' || MIN(date) || ' → ' || MAX(date) || ' (' || string_agg(DISTINCT account, ', ' ORDER BY account) || ')'
      FROM two WHERE commodity <> 'AUD' AND NOT COALESCE(q1 = 'AUD', FALSE) AND NOT COALESCE(q2 = 'AUD', FALSE) GROUP BY commodity""")
def issue_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of issues but suggestions and parse errors, when early prices of some brands are unknown and first lines are uncategorised."""
    line = ledger.lines(spark, sf_dir)
    first = line.where("l_linenumber = 1")
    warnings = line.where("l_linenumber < 3").select(F.when(F.col("l_linenumber") == 2, F.concat_ws(": ", "account", "narration")).otherwise(F.col("narration")).alias("warning"))
    held = line.select("account").distinct()
    declared = line.where("commodity = 'Brand_11' and qty > 49 and sgn > 0")
    known = ledger.prices(spark, sf_dir).where("not (commodity like 'Brand_4%' and date < '1997-01-01')")
    return issues.all_messages(
        issues.uncategorised_messages(first, ["date", *KEY, "payee", "narration"]), issues.warning_messages(warnings), issues.gap_messages(B.month_gaps(line)),
        issues.unverified_messages(held, declared), issues.unpriced_messages(line, known, "AUD"),
    )


def _unit_sql(day: str) -> str:
    return f"SELECT commodity, arg_max(price, date) AS unit FROM price WHERE date <= '{day}' AND quote = 'USD' GROUP BY 1"


@query(f"""{catalog.LOTS_SQL}, u0 AS ({_unit_sql("1996-06-30")}), u1 AS ({_unit_sql(END)}),
    h AS (SELECT commodity, CAST(SUM(CASE WHEN date < '{START}' THEN sgn * qty ELSE 0 END) AS DOUBLE) AS q0, CAST(SUM(CASE WHEN date <= '{END}' THEN sgn * qty ELSE 0 END) AS DOUBLE) AS q1,
      SUM(CASE WHEN sgn > 0 AND date BETWEEN '{START}' AND '{END}' THEN net ELSE 0 END) AS paid, SUM(CASE WHEN sgn < 0 AND date BETWEEN '{START}' AND '{END}' THEN net ELSE 0 END) AS received FROM line GROUP BY 1),
    s AS (SELECT commodity, SUM(proceeds - CASE WHEN buy_date >= '{START}' THEN cost ELSE taken * unit END) AS realised FROM t LEFT JOIN u0 USING (commodity) WHERE sell_date BETWEEN '{START}' AND '{END}' GROUP BY 1),
    w AS (SELECT commodity, COALESCE(realised, 0) AS realised, q1 * u1.unit - q0 * u0.unit - paid + received AS total_gain FROM h JOIN u0 USING (commodity) JOIN u1 USING (commodity) LEFT JOIN s USING (commodity))
    SELECT commodity, ROUND(realised, 4) AS realised, ROUND(total_gain - realised, 4) AS unrealised, ROUND(total_gain, 4) AS total_gain FROM w""")
def performance_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [*KEY, "quantity", "value"]
    return reports.attribution(ledger.trades(spark, sf_dir), order, ledger.prices(spark, sf_dir), START, END, "USD", ledger.commodities(spark, sf_dir))


@query("""SELECT 'txn:csv-' || SUBSTRING(sha256('o' || ':' || oid || '/' || l_linenumber), 1, 12) AS meta, date, payee, CAST(COALESCE(status, '') = '*' AS INT) + 2 AS legs,
    CAST(net - CASE WHEN status = '*' AND sgn > 0 THEN 1.5 ELSE 0 END AS DOUBLE) AS own, CASE WHEN status = '*' AND sgn < 0 THEN 'EUR' WHEN status = '*' THEN 'USD' END AS fee_in
    FROM line WHERE l_linenumber <> 3""")
def csv_to_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as rows of text, mapped to transactions: fees in their own currency for sales, in another for purchases, third lines skipped."""
    line = ledger.lines(spark, sf_dir)
    rows = line.select(
        F.lit("o").alias("file"), F.concat_ws("/", "oid", "l_linenumber").alias("row"), F.col("date").alias("Day"), F.col("payee").alias("Name"), F.concat(F.lit("$"), F.col("net").cast("decimal(24,2)").cast("string")).alias("Sum"),
        F.when(F.col("status") == "*", F.when(F.col("sgn") < 0, "1.5 EUR").otherwise("1.5")).alias("Fee"), (F.col("l_linenumber") == 3).alias("Third"),
    )
    mapping = {"date": "Day", "amount": "Sum", "payee": "Name", "fee": "Fee", "skip": "Third"}
    found = csv_rows.transactions(rows, mapping, "assets:bank")
    fee_in = F.get(F.col("postings"), F.lit(2))["commodity"]
    return found.select("meta", "date", "payee", F.size("postings").alias("legs"), F.col("postings")[0]["amount"].alias("own"), fee_in.alias("fee_in"))
