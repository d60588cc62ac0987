"""Lots read their events once, and ranges and windows of days give what a plain walk does."""

import random
from collections import deque

import duckdb
import pytest

from pennyworks.operators import lots, report_lines
from pennyworks.plans import catalog
from pennyworks.plans.ledger import TABLES


def _walk(rows):
    """(commodity, sale, lot, taken) of rows(commodity, date, n, quantity, value)."""
    held, found = {}, []
    for c, day, n, q, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        queue = held.setdefault(c, deque())
        if q > 0:
            queue.append([n, q])
        while q < 0 and queue:
            take = min(-q, queue[0][1])
            found.append((c, day, n, queue[0][0], round(take, 6)))
            q, queue[0][1] = q + take, queue[0][1] - take
            if queue[0][1] < 1e-12:
                queue.popleft()
    return found


@pytest.mark.parametrize("size", [3, 50_000])
def test_ranges_and_days(spark, monkeypatch, size):
    monkeypatch.setattr(lots, "ROWS", size)
    rng = random.Random(5)
    rows = [(c, f"2020-01-{rng.randint(1, 28):02d}", n, float(rng.choice([0.25, 5, 40, 3, -4, -0.5, -30])), float(rng.randint(1, 99))) for n, c in enumerate("XXYYZ" * 40)]
    rows += [("only sold", "2020-01-02", 900, -3.0, 1.0)]
    events = spark.createDataFrame(rows, "commodity string, date string, n int, quantity double, value double")
    told = lambda df: sorted((r.commodity, r.sale.date, r.sale.n, r.lot.n, round(r.taken, 6)) for r in df.collect())
    assert told(lots.match(events, ["n"])) == sorted(_walk(rows))
    some = [r for r in _walk(rows) if "2020-01-09" <= r[1] <= "2020-01-15"]
    assert some and told(lots.match(events, ["n"], ("2020-01-09", "2020-01-15"))) == sorted(some)


def test_a_report_of_gains_reads_its_events_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = [("X", f"2020-01-{n % 9 + 1:02d}", n, float([5, -2, -9][n % 3]), 10.0) for n in range(60)]

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    schema = "commodity string, date string, n int, quantity double, value double"
    events = spark.createDataFrame(rows, schema).mapInPandas(counted, schema)
    assert report_lines.gain_events(events, ["n", "quantity", "value"], "2020-01-01", "2020-12-31").count() > 10
    assert seen.value == len(rows)


def test_events_without_a_date_come_last_and_are_kept(spark):
    rows = [("X", None, 1, 5.0, 50.0), ("X", "2020-01-01", 2, 5.0, 10.0), ("X", "2020-01-02", 3, -3.0, 9.0), ("X", None, 4, -4.0, 8.0)]
    events = spark.createDataFrame(rows, "commodity string, date string, n int, quantity double, value double")
    assert sorted((r.sale.n, r.lot.n, r.taken) for r in lots.match(events, ["n"]).collect()) == [(3, 2, 3.0), (4, 1, 2.0), (4, 2, 2.0)]
    assert [(r.sale.n, r.lot.n, r.taken) for r in lots.match(events, ["n"], ("2020-01-01", "2020-12-31")).collect()] == [(3, 2, 3.0)]
    assert [(r.lot.n, r.left) for r in lots.remaining(events, ["n"]).collect()] == [(1, 3.0)]


def test_gains_hold_what_was_sold_beyond_the_holding(spark, tmp_path):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE TABLE {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    db.execute("UPDATE lineitem SET l_returnflag = 'R' WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate < '1997-03-01')")
    db.execute("UPDATE orders SET o_orderdate = NULL WHERE o_orderkey % 50 = 7")
    for t in TABLES:
        db.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    due = db.sql(catalog.ORACLES["cgt_events"])
    found = catalog.QUERIES["cgt_events"](spark, str(tmp_path)).select(*due.columns)
    told = lambda rows: sorted(tuple(round(v, 4) if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert told(found.collect()) == told(due.fetchall())
    bare, covered = found.where("buy_order is null"), found.where("buy_order is not null")
    assert bare.count() > 20 and covered.count() > 20
    assert bare.where("cost <> 0 or discount_eligible or abs(gain - proceeds) > 1e-9").isEmpty()
