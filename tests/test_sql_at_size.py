"""What only larger tables show: amounts with more digits than a double has decimals for, and ids of more digits."""

import random

import duckdb
from pyspark.sql import functions as F

from pennyworks.functions import formats


def test_decimals_of_doubles_equal_sql(spark):
    rng = random.Random(1)
    values = [rng.choice((-1, 1)) * rng.random() * 10 ** rng.randint(-12, 16) for _ in range(300)]
    values += [44749247036.82, 33089130792.000004, 3947392.8449999997, -26766037.224015605, 2.5e-10, -0.0, 0.005, None]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    found = rows.select("i", formats.fixed(F.col("v"), 6).alias("six"), formats.fixed(F.col("v"), 2).alias("two"), formats.exact(F.col("v"), 8).cast("string").alias("eight"))
    db = duckdb.connect()
    db.execute("CREATE TABLE t (i INT, v DOUBLE)")
    db.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    ten = "CAST(v AS DECIMAL(38,10))"
    due = db.execute(f"SELECT i, CAST(CAST({ten} AS DECIMAL(38,6)) AS VARCHAR), CAST(CAST({ten} AS DECIMAL(38,2)) AS VARCHAR), CAST(CAST(v AS DECIMAL(38,8)) AS VARCHAR) FROM t ORDER BY i").fetchall()
    assert [tuple(r) for r in found.orderBy("i").collect()] == due
    huge = spark.createDataFrame([(3e20,)], "v double").select(formats.fixed(F.col("v"), 2).alias("t")).first().t
    assert huge == "300000000000000000000.00"


def test_sums_of_an_income_report_equal_sql(spark):
    from pennyworks.operators import report_lines

    values = [3947392.8449999997, 119617.97 * 33, 26766037.224015605]
    rows = spark.createDataFrame([("A", "1996-10-14", k, "assets:a", "income:b", 1.0, v, v, False) for k, v in enumerate(values)], "commodity string, date string, n int, asset string, account string, quantity double, price double, value double, expense boolean")
    lines = [r.line for r in report_lines.income_lines(rows, ["n"], "1997").orderBy(*report_lines.SORT).collect()]
    db = duckdb.connect()
    two = lambda sql: db.execute(f"SELECT CAST(CAST(CAST({sql} AS DECIMAL(38,10)) AS DECIMAL(38,2)) AS VARCHAR)").fetchall()[0][0]
    total = two("(SELECT CAST(SUM(CAST(v AS DECIMAL(30,8))) AS DOUBLE) FROM (VALUES " + ", ".join(f"(CAST('{v!r}' AS DOUBLE))" for v in values) + ") t(v))")
    for v in values:
        assert any(line.endswith("," + two(f"CAST('{v!r}' AS DOUBLE)")) for line in lines)
    assert f"Section Total,,,,,,{total}" in lines


def test_scalar_functions_on_users_of_more_digits(spark, tmp_path):
    from pennyworks.plans import catalog, ledger_queries

    assert ledger_queries
    db = duckdb.connect()
    db.execute(f"COPY (SELECT * REPLACE (user_id + 1000 * (event_id % 20) AS user_id) FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    due = dict(db.execute(f"SELECT event_id, amount FROM ({catalog.ORACLES['scalar_functions']})").fetchall())
    assert {r.event_id: r.amount for r in catalog.QUERIES["scalar_functions"](spark, str(tmp_path)).collect()} == due
