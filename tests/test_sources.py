import gzip
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pennyworks.operators import lots, value_chain
from pennyworks.sources import ledger_text, store
from pennyworks.streaming import rebuild

TEXT = """; a comment
orphan line
    assets:lost 1.00 USD
2024-01-02 * "Ann" "Buys \\"two\\"" ; txn:1, src:a
    assets:broker  2.5 BTC {{ 100.00 USD, fee:0.10 USD, venue:x }}
    assets:cash  -100.00 USD

    assets:late  1 USD
account assets:broker
    opening 5 BTC
2024-13-40 Bob says more here
    assets:cash  x.y USD
    assets:cash
2024-02-01T10:00:00Z ! "Cy "unclosed rest
    assets:cash  -1 USD @ 1.5 AUD
"""


def cut(spark, text, sizes):
    """Lines of a file as if its splits had so many lines each."""
    rows, chunk, left = [], 0, list(sizes)
    for n, line in enumerate(text.split("\n")):
        rows.append(("f", chunk, n, line))
        if left and n + 1 == sum(sizes[: len(sizes) - len(left) + 1]):
            left.pop(0)
            chunk += 100
    return spark.createDataFrame(rows, "file string, chunk long, n long, value string").repartition(5)


@pytest.mark.parametrize("sizes", [[], [1], [4, 1, 1], [3, 2, 4, 5], [1] * 14])
def test_ledger_does_not_depend_on_splits(spark, sizes):
    found = ledger_text.parse_lines(cut(spark, TEXT, sizes)).orderBy("ord").collect()
    assert [(r.ord, r.date, r.status, r.payee, r.narration, r.meta) for r in found] == [
        (0, "2024-01-02", "*", "Ann", 'Buys "two"', "txn:1, src:a"), (1, "2024-13-40", None, "Bob", "says more here", None), (2, "2024-02-01", "!", "Cy ", "unclosed rest", None),
    ]
    assert [[(p.account, p.amount, p.commodity) for p in r.postings] for r in found] == [
        [("assets:broker", 2.5, "BTC"), ("assets:cash", -100.0, "USD")], [("assets:cash", 0.0, "USD")], [("assets:cash", -1.0, "USD")],
    ]
    cost = found[0].postings[0].cost
    assert (cost.is_total, cost.amount, cost.commodity, cost.fields) == (True, 100.0, "USD", ["fee:0.10 USD", "venue:x"]) and found[2].postings[0].price.amount == 1.5
    odd = ledger_text.diagnostics(cut(spark, TEXT, sizes)).orderBy("n").collect()
    assert [(r.n, r.problem) for r in odd] == [
        (1, "unknown line"), (2, "posting outside a transaction"), (7, "posting outside a transaction"), (10, "bad date"), (11, "bad amount"), (12, "incomplete posting"),
    ]


def test_ledger_from_splits_of_a_file(spark, tmp_path):
    """A file that Spark cuts into many splits gives the same transactions as one read whole."""
    (tmp_path / "long.txt").write_text("\n".join(f'2024-01-{k % 28 + 1:02d} "p{k}" ; txn:{k}\n    assets:a  {k}.5 USD\n    assets:b  -{k}.5 USD\n' for k in range(400)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = ledger_text.read_lines(spark, str(tmp_path))
        assert lines.select("chunk").distinct().count() > 5
        found = ledger_text.parse_lines(lines).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.ord, r.payee, r.meta, r.postings[0].amount, len(r.postings)) for r in found] == [(k, f"p{k}", f"txn:{k}", k + 0.5, 2) for k in range(400)]
    assert ledger_text.excluding(ledger_text.read(spark, str(tmp_path)), "txn:39").count() == 400 - 11


def test_price_problems(spark):
    lines = ["P 2024-01-01 BTC 10 USD", "P 2024-01-01 BTC x USD", "P 2024-99-01 BTC 1 USD", "P 2024-01-01 BTC", "Q 1", "; c", ""]
    found = ledger_text.price_problems(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.problem for r in found] == ["bad amount", "bad date", "incomplete price", "unknown line"]


def write(path, folder, name, rows):
    (path / f"folder={folder}").mkdir(parents=True, exist_ok=True)
    (path / f"folder={folder}" / name).write_text("".join(f'2024-01-01 "p" ; txn:{k}\n    assets:{folder}  {v} USD\n    equity:x  -{v} USD\n\n' for k, v in rows))


def stored(spark, path):
    rows = store.load(spark, str(path)).select("folder", "meta", F.col("postings")[0]["amount"].alias("x")).collect()
    return sorted((r.folder, r.meta, r.x) for r in rows)


def test_store_follows_files(spark, tmp_path):
    source, path, seen = tmp_path / "in", tmp_path / "store", str(tmp_path / "seen")
    write(source, "a", "1.txt", [(1, 10), (2, 20)])
    write(source, "b", "1.txt", [(3, 30)])
    assert rebuild.follow(spark, str(source), str(path), seen) == 1
    assert stored(spark, path) == [("a", "txn:1", 10.0), ("a", "txn:2", 20.0), ("b", "txn:3", 30.0)]
    parts = {p: p.stat().st_mtime_ns for p in path.glob("txns/*/*/*.parquet")}
    assert rebuild.follow(spark, str(source), str(path), seen) == 0  # nothing new
    write(source, "b", "2.txt", [(4, 40)])
    assert rebuild.follow(spark, str(source), str(path), seen) == 1
    assert stored(spark, path) == [("a", "txn:1", 10.0), ("a", "txn:2", 20.0), ("b", "txn:3", 30.0), ("b", "txn:4", 40.0)]
    assert all(p.stat().st_mtime_ns == t for p, t in parts.items() if "folder=a" in str(p))  # the other folder keeps its files
    whole, versions = stored(spark, path), len(list(path.glob("digests/*.parquet")))
    assert rebuild.follow(spark, str(source), str(path), str(tmp_path / "forgotten"), files=1) == 0  # all batches replayed
    assert stored(spark, path) == whole and len(list(path.glob("digests/*.parquet"))) == versions
    (source / "folder=a" / "1.txt").write_text("")
    (source / "folder=a" / "3.txt").write_text("; nothing is left here\n")
    rebuild.follow(spark, str(source), str(path), seen)
    assert stored(spark, path) == [("b", "txn:3", 30.0), ("b", "txn:4", 40.0)]
    assert store.prune(spark, str(path)) == 1 and not list(path.glob("txns/*/folder=a"))
    assert stored(spark, path) == [("b", "txn:3", 30.0), ("b", "txn:4", 40.0)]


def fifo(events):
    """(sale, lot, taken) by a queue of lots, in whole units of 1e-12."""
    held, out = [], []
    for at, q in events:
        if q > 0:
            held.append([at, q])
            continue
        need = -q
        while need and held:
            took = min(need, held[0][1])
            out.append((at, held[0][0], took))
            need, held[0][1] = need - took, held[0][1] - took
            if not held[0][1]:
                held.pop(0)
    return out


@pytest.mark.parametrize("rows", [3, 50_000])
def test_lots_of_fractions_in_ranges(spark, rows, monkeypatch):
    monkeypatch.setattr(lots, "ROWS", rows)
    rng = random.Random(9)
    events = [("X", f"2024-01-{k // 9 + 1:02d}", k, rng.choice([1, 1, -1]) * (rng.randrange(1, 10**15) / 10**6 + 0.1)) for k in range(240)]
    df = spark.createDataFrame([(c, d, k, q, 1.0) for c, d, k, q in events] + [("Y", "2024-01-01", 1, 5.0, 1.0)], "commodity string, date string, ord int, quantity double, value double")
    found = sorted((r.sale.ord, r.lot.ord, r.taken) for r in lots.match(df.repartition(4), ["ord", "quantity", "value"]).collect())
    unit = lambda q: int(Decimal(repr(q)).quantize(Decimal("1e-12")) * 10**12)
    due = sorted(fifo([(k, unit(q)) for _, _, k, q in events]))
    assert [f[:2] for f in found] == [d[:2] for d in due if d[2] > 100]
    assert all(math.isclose(f[2], d[2] / 1e12, rel_tol=1e-12) for f, d in zip(found, [d for d in due if d[2] > 100], strict=True))


def test_value_chain(spark):
    note = lambda total, amount, of: (total, amount, of)
    rows = [
        ("cost", 0, "assets:a", 2.0, "BTC", note(True, 100.0, "USD"), note(False, 7.0, "AUD")), ("cost", 1, "equity:x", -50.0, "AUD", None, None),
        ("sold", 0, "assets:a", -2.0, "BTC", note(True, 100.0, "USD"), None), ("sold", 1, "assets:cash", 50.0, "AUD", None, None),
        ("asset", 0, "assets:a", 2.0, "BTC", None, None), ("asset", 1, "assets:b", -4.0, "ODD", None, note(False, 3.0, "AUD")),
        ("other", 0, "assets:a", 2.0, "BTC", None, None), ("other", 1, "equity:x", -10.0, "USD", None, None),
        ("half", 0, "assets:a", 2.0, "BTC", None, None), ("half", 1, "equity:x", -2.0, "BTC", None, None), ("far", 0, "assets:b", -5.0, "USD", None, None),
        ("own", 0, "assets:a", 2.0, "BTC", None, None), ("none", 0, "assets:a", 2.0, "ODD", None, None), ("none", 1, "assets:b", 0.0, "ODD", None, None),
        ("moved", 0, "assets:a", 2.0, "BTC", None, None), ("moved", 1, "assets:b", -2.0, "BTC", None, None), ("odd", 0, "assets:a", 1.0, "BTC", note(False, 9.0, "ODD"), None),
    ]
    mark = "struct<is_total: boolean, amount: double, commodity: string>"
    legs = spark.createDataFrame([(t, p, "2024-01-05", *r) for t, p, *r in rows], f"txn string, pos int, date string, account string, amount double, commodity string, cost {mark}, price {mark}")
    quotes = spark.createDataFrame([("BTC", "2024-01-01", 40.0, "USD"), ("USD", "2024-01-01", 1.5, "AUD")], "commodity string, date string, price double, quote string")
    siblings = spark.createDataFrame([("half", "far")], "txn string, sibling string")
    found = {(r.txn, r.pos): (r.value, r.origin, r.moved) for r in value_chain.chained(legs, quotes, "AUD", siblings).collect()}
    assert found == {
        ("cost", 0): (150.0, "cost", False), ("sold", 0): (50.0, "base", False), ("asset", 0): (12.0, "asset", False), ("asset", 1): (12.0, "price", False), ("other", 0): (15.0, "converted", False),
        ("half", 0): (7.5, "sibling", False), ("far", 0): (7.5, "own", False), ("own", 0): (120.0, "own", False), ("none", 0): (0.0, "none", False),
        ("moved", 0): (120.0, "own", True), ("moved", 1): (120.0, "own", True), ("odd", 0): (9.0, "cost", False),
    }


def test_text_is_cut_where_it_is_read(spark, tmp_path):
    """Lines of a file meet no shuffle; blocks do not depend on how many lines come at once, nor a folder's order on how many files it has."""
    (tmp_path / "a.txt").write_text("".join(f'2024-01-01 "p{k}" ; txn:{k}\n' + f"    assets:a  {k} USD\n" * (k % 5) + "; note\n" * (k % 2) + "\n   \n    stray 1\n" * (k % 3 == 0) for k in range(60)))
    (tmp_path / "b.txt").write_text("no header\n\n    here\n" * 40)
    due, before = [(k, f"p{k}", k % 5) for k in range(60)], {c: spark.conf.get(c) for c in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.maxPartitionBytes")}
    try:
        for at_once, size in ((1, "1000000"), (7, "300"), (10000, "97"), (10000, "1000000")):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at_once)
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            txns = ledger_text.read(spark, str(tmp_path))
            assert [(r.ord, r.payee, len(r.postings)) for r in txns.orderBy("ord").collect()] == due
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    plan = txns._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and "hashpartitioning" not in plan
    rows = spark.createDataFrame([(f"2024-01-{k % 28 + 1:02d}", f"txn:{k:03d}", [("assets:a", 1.0, "USD")]) for k in range(300)], "date string, meta string, postings array<struct<account: string, amount: double, commodity: string>>")
    rows = rows.selectExpr("*", "'here' as folder", "cast(null as string) as status", "'p' as payee", "'n' as narration")
    ledger_text.write(rows, str(tmp_path / "out"))
    heads = [line.split(" ; ") for f in sorted((tmp_path / "out/folder=here").glob("*.gz")) for line in gzip.decompress(f.read_bytes()).decode().split("\n") if ";" in line]
    assert [(h[0][:10], h[1]) for h in heads] == sorted((r.date, r.meta) for r in rows.collect())
