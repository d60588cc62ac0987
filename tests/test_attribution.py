"""Attribution reads its events once, orders few of them, and gives what a plain walk and the SQL do."""

import random
from collections import deque

import duckdb
import pytest

from pennyworks.operators import lots, reports

SCHEMA = "commodity string, date string, n int, quantity double, value double"


def _counted(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    def walk(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return spark.createDataFrame(rows, SCHEMA).mapInArrow(walk, SCHEMA), seen


def _walk(rows, start, end):
    """commodity -> q0, q1, paid, received, got, old, spent, lot by lot."""
    due, held = {}, {}
    for c, day, _, q, v in sorted((r for r in rows if r[1] <= end), key=lambda r: (r[1], r[2])):
        s, queue = due.setdefault(c, [0.0] * 7), held.setdefault(c, deque())
        s[0], s[1] = s[0] + q * (day < start), s[1] + q
        if day >= start:
            s[2 if q > 0 else 3] += v
        if q > 0:
            queue.append([day, q, v / q])
        left = -q
        while left > 0 and queue:
            lot = queue[0]
            take = min(left, lot[1])
            if day >= start:
                s[4] += v * take / -q
                s[5 if lot[0] < start else 6] += take if lot[0] < start else take * lot[2]
            left, lot[1] = left - take, lot[1] - take
            if lot[1] < 1e-12:
                queue.popleft()
    return due


@pytest.mark.parametrize("sizes", [(5, 40, 3, -4, -0.5, -30), (0.25, 5, -4, -6, 0), (7, 0.3, 2, -1, -2), (-1, -2)])
def test_turnover_is_that_of_a_walk(spark, sizes):
    rng = random.Random(1)
    rows = [(c, f"2020-01-{rng.randint(1, 28):02d}", n, float(rng.choice(sizes)), float(rng.randint(1, 99))) for n, c in enumerate("XXYYZ" * 40)]
    found = lots.turnover(spark.createDataFrame(rows, SCHEMA), ["n"], "2020-01-09", "2020-01-19")
    due = _walk(rows, "2020-01-09", "2020-01-19")
    assert {r[0]: pytest.approx(list(r[1:])) for r in found.collect()} == due


def test_attribution_reads_once_and_orders_little(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("X", f"2020-01-{1 + n // 20:02d}", n, float(rng.choice([9, 5, -2])), 8.0) for n in range(400)] + [("late", "2020-01-25", 900, 3.0, 8.0), ("unpriced", "2020-01-03", 901, 3.0, 8.0)]
    events, seen = _counted(spark, rows)
    ordered, by_day = [], lots._by_day
    monkeypatch.setattr(lots, "_by_day", lambda df, order: ordered.append(df.count()) or by_day(df, order))
    quotes = spark.createDataFrame([("X", "2020-01-02", 3.0, "USD"), ("X", "2020-01-11", 4.0, "USD"), ("X", "2020-01-21", 99.0, "USD"), ("late", "2020-01-01", 1.0, "USD")], "commodity string, date string, price double, quote string")
    names = spark.createDataFrame([("X",), ("unpriced",)], "commodity string")
    found = reports.attribution(events, ["n"], quotes, "2020-01-08", "2020-01-15", "USD", names).collect()
    q0, q1, paid, received, got, old, spent = _walk(rows, "2020-01-08", "2020-01-15")["X"]
    gain, realised = q1 * 4 - q0 * 3 - paid + received, got - spent - old * 3
    assert [tuple(r) for r in found] == [("X", pytest.approx(realised), pytest.approx(gain - realised), pytest.approx(gain))]
    assert seen.value == len(rows)
    assert sum(ordered) <= 60
    names = names.union(spark.createDataFrame([("late",)], "commodity string"))
    for given in (names, None):
        found = reports.attribution(events, ["n"], quotes, "2020-01-08", "2020-01-15", "USD", given).collect()
        assert sorted(tuple(r) for r in found)[1] == ("late", 0.0, 0.0, 0.0)


def test_query_reads_lines_once_for_events_and_once_for_prices(spark, monkeypatch):
    from pennyworks.plans import catalog, ledger, swap_queries

    assert swap_queries
    seen, tables = spark.sparkContext.accumulator(0), ledger._tables

    def walk(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def counted(session, sf_dir):
        found = tables(session, sf_dir)
        return found | {"lineitem": found["lineitem"].mapInArrow(walk, found["lineitem"].schema)}

    monkeypatch.setattr(ledger, "_tables", counted)
    assert catalog.QUERIES["performance_attribution"](spark, "/root/testdata/sf0.001").count() == 25
    assert seen.value == 2 * spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_query_on_odd_tables_equals_sql(spark, tmp_path):
    """A brand that is only sold, one that is sold first, one traded only after the window, a line without customer and one without a day."""
    from pennyworks.plans import catalog, swap_queries

    assert swap_queries
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem"):
        db.execute(f"CREATE TABLE {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    brand = lambda n: f"l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = (SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 1 OFFSET {n}))"
    db.execute(f"UPDATE lineitem SET l_returnflag = 'R' WHERE {brand(0)}")
    db.execute(f"UPDATE lineitem SET l_returnflag = CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate < '1996-10-01') THEN 'R' ELSE 'N' END WHERE {brand(1)}")
    db.execute(f"DELETE FROM lineitem WHERE {brand(2)} AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate <= '1997-06-30')")
    db.execute(f"UPDATE lineitem SET l_shipdate = '1996-01-05' WHERE {brand(2)}")
    db.execute("UPDATE orders SET o_custkey = -1 WHERE o_orderkey % 50 = 7")
    db.execute("UPDATE orders SET o_orderdate = NULL WHERE o_orderkey % 50 = 9")
    for t in ("region", "nation", "customer", "part", "orders", "lineitem"):
        db.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    due = {r[0]: r[1:] for r in db.execute(catalog.ORACLES["performance_attribution"]).fetchall()}
    found = {r[0]: pytest.approx(tuple(r[1:]), rel=1e-9, abs=2e-4) for r in catalog.QUERIES["performance_attribution"](spark, str(tmp_path)).collect()}
    assert (0.0, 0.0, 0.0) in due.values()
    assert found == due
