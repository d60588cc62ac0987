"""Reports as lines and files, and sales beyond the holding, against plain loops."""

import glob
import random

from pyspark.sql import functions as F

from pennyworks.operators import lots, report_lines
from pennyworks.plans import report_line_queries
from pennyworks.sources import report_files

MOVE = "commodity string, date string, n int, quantity double, value double"


def text_of(path):
    return [line for name in sorted(glob.glob(f"{path}/part-*")) for line in open(name).read().splitlines()]


def test_oversold_equals_a_loop(spark):
    draw = random.Random(9)
    rows = [(c, f"2020-01-{draw.randint(1, 20):02d}", n, draw.choice([1.5, 2.0, 0.25, -3.0, -1.75]), 10.0) for n in range(200) for c in "XY"]
    due = {}
    held = dict.fromkeys("XY", 0.0)
    for c, day, n, quantity, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        missing = max(0.0, -quantity - held[c])
        held[c] = max(0.0, held[c] + quantity)
        if missing > 1e-10:
            due[c, n] = missing
    moves = spark.createDataFrame(rows, MOVE)
    found = {(r.commodity, r.sale.n): r.missing for r in lots.oversold(moves, ["n"]).collect()}
    assert found == due and len(due) > 20
    taken = lots.match(moves, ["n", "quantity", "value"]).agg(F.sum("taken")).first()[0]
    sold = sum(-r[3] for r in rows if r[3] < 0)
    assert abs(taken + sum(due.values()) - sold) < 1e-9
    assert lots.oversold(moves.where("false"), ["n"]).collect() == []
    never = spark.createDataFrame([("N", "2020-01-01", 1, -2.0, 8.0)], MOVE)
    assert lots.match(never, ["n", "quantity", "value"]).collect() == []
    assert [r.missing for r in lots.oversold(never, ["n"]).collect()] == [2.0]


def test_a_gains_report_as_a_file(spark, tmp_path):
    rows = [
        ("A,B", "2020-01-10", 1, 10.0, 100.0), ("Z", "2020-02-01", 2, 4.0, 40.0), ("A,B", "2021-01-09", 3, -2.0, 50.0), ("A,B", "2021-01-10", 4, -2.5, 50.0),
        ("Z", "2021-03-01", 5, -6.0, 30.0), ("Z", "2020-12-31", 6, -1.0, 5.0),
    ]
    order = ["n", "quantity", "value"]
    events = report_lines.gain_events(spark.createDataFrame(rows, MOVE), order, "2021-01-01", "2021-12-31")
    lines = report_lines.gain_lines(events, order, "2021")
    report_files.write_lines(lines, list(report_lines.SORT), str(tmp_path / "gains"))
    assert text_of(tmp_path / "gains") == [
        "Capital Gains Report", "Financial Year,2021", "Inventory Method,FIFO", "", "Report Summary", "Short Term Capital Gains,45.00", "Long Term Capital Gains,25.00",
        "Total Capital Losses,-15.00", "Net Total Capital Gains,55.00", "Discounted Gain,42.50", "",
        "Short-Term", "Section Total,,,,20.00,65.00,45.00", "Commodity,Bought,Sold,Quantity,Cost,Proceeds,Gain/Loss,Days",
        '"A,B"', ",2020-01-10,2021-01-09,2,20.00,50.00,30.00,364", '"A,B subtotal",,,2,20.00,50.00,30.00',
        "Z", ",2021-03-01,2021-03-01,3,0.00,15.00,15.00,0", "Z subtotal,,,3,0.00,15.00,15.00", "",
        "Long-Term", "Section Total,,,,25.00,50.00,25.00", "Commodity,Bought,Sold,Quantity,Cost,Proceeds,Gain/Loss,Days",
        '"A,B"', ",2020-01-10,2021-01-10,2.5,25.00,50.00,25.00,365", '"A,B subtotal",,,2.5,25.00,50.00,25.00', "",
        "Losses", "Section Total,,,,30.00,15.00,-15.00", "Commodity,Bought,Sold,Quantity,Cost,Proceeds,Gain/Loss,Days",
        "Z", ",2020-02-01,2021-03-01,3,30.00,15.00,-15.00,393", "Z subtotal,,,3,30.00,15.00,-15.00",
    ]
    bare = report_lines.gain_lines(events.where("false"), order, "2021")
    report_files.write_lines(bare, list(report_lines.SORT), str(tmp_path / "none"))
    none = text_of(tmp_path / "none")
    assert none.count("(no events)") == 3 and none.count("Section Total,,,,0.00,0.00,0.00") == 3 and "Discounted Gain,0.00" in none


def test_income_and_holdings_as_files(spark, tmp_path):
    rows = [("BTC", "2020-08-01", 1, "assets:a", "income:staking", 0.5, 10.0, 5.0, False), ("USD", "2020-07-02", 2, "assets:b", "expenses:fees", 3.0, 1.5, 4.5, True), ("BTC", "2020-09-01", 3, "assets:a", 'income:"x"', 1.25, 8.0, 10.0, False)]
    income = spark.createDataFrame(rows, "commodity string, date string, n int, asset string, account string, quantity double, price double, value double, expense boolean")
    report_files.write_lines(report_lines.income_lines(income, ["n"], "2021"), list(report_lines.SORT), str(tmp_path / "income"))
    assert text_of(tmp_path / "income") == [
        "Income Tax Report", "Financial Year,2021", "", "Report Summary", "Total Income,15.00", "Total Expenses,4.50", "Net,10.50", "",
        "Income", "Section Total,,,,,,15.00", "Commodity,Date,Where,Category,Quantity,Price,Value", "BTC", ",2020-08-01,assets:a,income:staking,0.5,10.00,5.00",
        ',2020-09-01,assets:a,"income:""x""",1.25,8.00,10.00', "BTC subtotal,,,,1.75,,15.00", "",
        "Expenses", "Section Total,,,,,,4.50", "Commodity,Date,Where,Category,Quantity,Price,Value", "USD", ",2020-07-02,assets:b,expenses:fees,3,1.50,4.50", "USD subtotal,,,,3,,4.50",
    ]
    held = spark.createDataFrame([("A", 1.0, 2.0, "2020-01-01", 2.0, 0.25), ("B", 3.0, 2.0, "2020-01-02", 6.0, 0.75)], "commodity string, quantity double, price double, price_date string, value double, weight double")
    report_files.write_lines(report_lines.holding_lines(held, "AUD", "2020-06-30"), ["section", "key", "commodity"], str(tmp_path / "held"))
    assert text_of(tmp_path / "held") == [
        "commodity,quantity,price,price_date,value,portfolio_weight,base_currency,as_of_date", "B,3.000000,2.000000,2020-01-02,6.000000,0.750000,AUD,2020-06-30", "A,1.000000,2.000000,2020-01-01,2.000000,0.250000,AUD,2020-06-30",
    ]


def test_the_tables_sell_more_than_they_hold(spark):
    found = report_line_queries.cgt_report(spark, "/root/testdata/sf0.001")
    assert found.where("buy_date is null").count() > 0
