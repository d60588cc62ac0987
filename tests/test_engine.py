import math
import random
from collections import deque

import duckdb
import pytest
from pyspark.sql import functions as F

from pennyworks.functions import search
from pennyworks.functions.patterns import wildcard_regex
from pennyworks.operators import files, lots, prices, reports, swaps
from pennyworks.plans import catalog, ledger_queries, report_queries, swap_queries
from pennyworks.plans.ledger import TABLES
from pennyworks.sources import ledger_text, ofx
from pennyworks.streaming import ingest

assert report_queries and ledger_queries and swap_queries
SF = "/root/testdata/sf0.001"


def plain(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        return repr(round(v, 4)) if isinstance(v, float) else str(v).removesuffix("+00:00")

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in (*TABLES, "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = catalog.QUERIES[name](spark, SF)
    due = db.sql(catalog.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(due.columns)
    assert plain(found.select(*columns).collect()) == plain(due.select(*columns).fetchall())


def test_search_grammar():
    assert search.parse("") == [[]]
    assert [len(x) for x in search.parse("payee:a AND -b OR is:swap")] == [2, 1]
    for bad in ("AND a", "a OR", "a AND AND b", "colour:red", "is:blue"):
        with pytest.raises(ValueError):
            search.parse(bad)


def test_wildcards():
    import re

    assert wildcard_regex("") is None
    assert re.match(wildcard_regex("shop*|*café"), "SHOP 12") and not re.match(wildcard_regex("shop"), "shops")


def test_lots_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(c, f"2020-01-{rng.randint(1, 9):02d}", i, float(rng.choice([5, 3, 2, -4, -6])), float(rng.randint(1, 99))) for i in range(150) for c in "XY"]
    due = []
    for c in "XY":
        held = deque()
        for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1:3]):
            left = abs(r[3])
            if r[3] > 0:
                held.append([left, r[2]])
                continue
            while left > 0 and held:
                taken = min(left, held[0][0])
                due.append((c, r[2], held[0][1], taken))
                held[0][0] -= taken
                left -= taken
                if held[0][0] == 0:
                    held.popleft()
    events = spark.createDataFrame(rows, "commodity string, date string, ord int, quantity double, value double")
    found = lots.match(events, ["ord"]).select("commodity", "sale.ord", "lot.ord", "taken").collect()
    assert sorted(map(tuple, found)) == sorted(due)


def test_as_of_prices(spark):
    price = spark.createDataFrame([("A", "2020-01-05", 2.0, "USD"), ("A", "2020-02-05", 3.0, "USD"), ("USD", "2020-01-01", 1.5, "AUD")], "commodity string, date string, price double, quote string")
    asked = spark.createDataFrame([(1, "A", "2020-01-04"), (2, "A", "2020-01-05"), (3, "A", "2020-09-01"), (4, None, "2020-01-01")], "id int, commodity string, date string")
    found = {r.id: r.p and r.p.price for r in prices.as_of(asked, price, "commodity", "date", "p").collect()}
    assert found == {1: None, 2: 2.0, 3: 3.0, 4: None}
    first = {r.id: r.p and r.p.price for r in prices.as_of(asked, price, "commodity", "date", "p", first_if_none=True).collect()}
    assert first[1] == 2.0
    amounts = asked.selectExpr("*", "10.0D as amount")
    assert {r.id: r.value for r in prices.convert(amounts, price, "AUD").collect()} == {1: None, 2: 30.0, 3: 45.0, 4: None}


LEDGER = """; kept by hand
2024-03-02 ! "Corner \\"Deli\\"" "Lunch for two" ; txn:k7, src:till
    assets:points    4.25 PTS {{ 17.00 EUR, fee:0.05 EUR }} @ 4 EUR
    assets:wallet   -17.05 EUR
    expenses:tips  none EUR

2024-03-03T08:30:00 Baker rolls and jam
    assets:wallet  -3 EUR
    unfinished
"""


def test_ledger_text(spark):
    rows = ledger_text.parse(spark.createDataFrame([("f", LEDGER)], "file string, value string")).orderBy("ord").collect()
    a, b = rows
    assert (a.date, a.status, a.payee, a.narration, a.meta) == ("2024-03-02", "!", 'Corner "Deli"', "Lunch for two", "txn:k7, src:till")
    assert [(p.account, p.amount, p.commodity) for p in a.postings] == [("assets:points", 4.25, "PTS"), ("assets:wallet", -17.05, "EUR"), ("expenses:tips", 0.0, "EUR")]
    assert a.postings[0].cost.is_total and a.postings[0].cost.amount == 17.0 and not a.postings[0].price.is_total
    assert (b.datetime, b.payee, b.narration, len(b.postings)) == ("2024-03-03T08:30:00", "Baker", "rolls and jam", 1)


def test_written_ledger_is_read_back(spark, tmp_path):
    txns = ledger_text.parse(spark.createDataFrame([("f", LEDGER)], "file string, value string")).withColumn("folder", F.lit("home"))
    ledger_text.write(txns, str(tmp_path / "out"))
    again = ledger_text.parse(spark.read.text(str(tmp_path / "out/folder=home"), wholetext=True).select(F.lit("g").alias("file"), "value"))
    short = lambda df: sorted((r.date, r.payee, r.narration, tuple((p.account, p.amount, p.commodity) for p in r.postings)) for r in df.collect())
    assert short(again) == short(txns)


def test_price_csv_and_declared_accounts(spark):
    rows = spark.createDataFrame([("EUR", "2024-01-02", " 1.5 ", "ABC"), ("EUR", "2024-01-03", "n/a", "ABC")], "CURRENCY string, date string, Price string, Commodity string")
    assert [tuple(r) for r in ledger_text.price_csv(rows).collect()] == [("ABC", "2024-01-02", 1.5, "EUR")]
    text = "account assets:wallet\n  opening -2.5 EUR\n  name My wallet \naccount assets:x\n\n2024-01-01 A\n    assets:x  1 EUR\n"
    found = ledger_text.accounts(spark.createDataFrame([("f", text)], "file string, value string")).orderBy("ord").collect()
    assert [tuple(r)[2:] for r in found] == [("assets:wallet", -2.5, "EUR", None, "My wallet"), ("assets:x", None, None, None, None)]


def test_price_lines(spark):
    rows = ledger_text.price_lines(spark.createDataFrame([("P 2026-01-15 BTC 30000.00 USD",), ("; P x",), ("P 2026-01-15 BTC x USD",)], "value string"))
    assert [tuple(r) for r in rows.collect()] == [("BTC", "2026-01-15", 30000.0, "USD")]


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.unionByName(events.limit(50)).repartition(3).write.parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    stream = ingest.daily_totals(ingest.event_stream(spark, str(tmp_path / "in"), schema).withColumn("ts", F.col("ts").cast("timestamp")))
    query = stream.writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert plain(spark.table("totals").drop("total").collect()) == plain(ingest.daily_totals(events).drop("total").collect())


OFX = """<OFX><CURDEF>AUD<DTSTART>20260101
<STMTTRN><TRNTYPE>DEBIT<DTPOSTED>20260105120000<TRNAMT>-5.50<FITID>a1<NAME>Shop</STMTTRN>
<stmttrn><trntype>CREDIT<dtposted>20260106<trnamt>1,200.00<memo>Pay
</stmttrn><STMTTRN><TRNTYPE>CREDIT<DTPOSTED>20260106<TRNAMT>1,200.00<MEMO>Pay
</STMTTRN></OFX>"""


def test_ofx(spark):
    lines = ofx.statements(spark.createDataFrame([("f", OFX), ("empty", ""), ("null", None)], "file string, value string"))
    a, b, c = lines.orderBy("pos").collect()
    assert (a.currency, a.date, a.amount, a.fitid, a.memo) == ("AUD", "2026-01-05", -5.5, "a1", "Shop")
    assert (b.date, b.amount, b.memo) == ("2026-01-06", 1200.0, "Pay")
    assert b.fitid.startswith("syn-") and c.fitid.startswith("syn-") and b.fitid != c.fitid
    txns = ofx.transactions(lines, "assets:bank").collect()
    assert len({t.meta for t in txns}) == 3 and all(sum(p.amount for p in t.postings) == 0 for t in txns)


def test_what_is_left_of_lots(spark):
    rows = [("A", "2025-01-01", 1, 10.0, 1000.0), ("A", "2025-02-01", 2, 5.0, 1000.0), ("A", "2025-08-10", 3, -12.0, 3600.0), ("B", "2025-01-01", 4, -3.0, 9.0), ("B", "2025-01-02", 5, 2.0, 8.0)]
    events = spark.createDataFrame(rows, "commodity string, date string, ord int, quantity double, value double")
    assert {(r.commodity, r.lot.ord, r.left) for r in lots.remaining(events, ["ord"]).collect()} == {("A", 2, 3.0), ("B", 5, 2.0)}
    sold = [(r.taken, r.cost, r.proceeds, r.gain) for r in lots.gains(lots.match(events, ["ord"])).orderBy("lot.ord").collect()]
    assert sold == [(10.0, 1000.0, 3000.0, 2000.0), (2.0, 400.0, 600.0, 200.0)]


def test_snapshot_dates():
    assert reports.snapshot_dates("2024-02-10", "2024-04-15") == ["2024-02-09", "2024-02-29", "2024-03-31", "2024-04-15"]
    assert reports.snapshot_dates("2024-02-01", "2024-02-29") == ["2024-01-31", "2024-02-29"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "folder string, file string, size double, day string, key string")
    assert files.winners(none).count() == 0
    legs = spark.createDataFrame([], "id int, date string, account string, commodity string, amount double")
    assert swaps.rank_pairs(legs, ["date", "account"], ["id"]).count() == 0 == swaps.adjacent_pairs(legs, ["id"]).count()
