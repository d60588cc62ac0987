import random

import pytest
from pyspark.sql import functions as F

from pennyworks.functions import formats, scalars
from pennyworks.operators import chain_records, edits, files, folders, prices, valuation
from pennyworks.sources import manual
from pennyworks.sources.ledger_text import price_lines


def test_folders_inherit(spark):
    within = spark.createDataFrame([("a:b:c",), ("a:b",), ("a:x",), ("z",), (None,), ("a:b:c",)], "folder string")
    specs = spark.createDataFrame([("a", "A"), ("a:b", "B2"), ("a:b", "B1"), ("a:bb", "no")], "path string, spec string")
    assert sorted(tuple(r) for r in folders.nearest(within, specs).collect()) == [("a:b", "a:b", "B1"), ("a:b:c", "a:b", "B1"), ("a:x", "a", "A")]
    rules = spark.createDataFrame([("a", 1, "a1"), ("a:b", 2, "b2"), ("a:b", 1, "b1"), ("", 1, "root")], "path string, ord int, rule string")
    found = folders.rules_chain(within, rules).orderBy("folder", "place").collect()
    assert [r.rule for r in found if r.folder == "a:b:c"] == ["b1", "b2", "a1", "root"] and [r.rule for r in found if r.folder == "z"] == ["root"]


def test_edits_in_any_order(spark):
    rng = random.Random(1)
    log = [(rng.randrange(12), k, rng.choice(["put", "put", "put", "delete"]), rng.choice([None, f"p{k}"]), rng.choice([None, k])) for k in range(90)]
    state = {}
    for key, at, op, a, b in log:
        if op == "delete":
            state.pop(key, None)
            continue
        old = state.get(key, (None, None, at))
        state[key] = (a if a is not None else old[0], b if b is not None else old[1], old[2])
    due = sorted((k, *v) for k, v in state.items())
    for seed in range(3):
        rng = random.Random(seed)
        shuffled = rng.sample(log, len(log)) + log[:5]  # and some edits twice
        found = edits.state(spark.createDataFrame(shuffled, "id int, at int, op string, a string, b int").repartition(3), "id", ["at"], ["a", "b"])
        assert sorted(tuple(r) for r in found.collect()) == due
    names = spark.createDataFrame([(1, "old", 1), (2, "kept", 2)], "id int, account string, place_at int")
    moves = spark.createDataFrame([("old", "new", 1), ("old", "newer", 2)], "old string, new string, at int")
    assert {r.id: r.account for r in edits.renamed(names, moves, "account", ["at"]).collect()} == {1: "newer", 2: "kept"}
    rules = spark.createDataFrame([("f", "Shop*", 1), ("f", "txn:9", 5), ("f", "txn:1", 7), ("f", "*", 2)], "folder string, pattern string, place_at int")
    assert [r.pattern for r in edits.anchored(rules, ["folder"]).orderBy("ord").collect()] == ["txn:9", "txn:1", "Shop*", "*"]


def test_duplicates_go_once(spark):
    rows = [("f", "long", 10, "2024-01-01", "a"), ("f", "long", 10, "2024-03-01", "b"), ("f", "short", 99, "2024-01-01", "a"), ("f", "short", 99, "2024-01-02", "c"), ("f", "copy", 1, "2024-01-01", "a"), ("g", "short", 1, "2024-01-01", "a"), ("f", "copy", 1, "2024-01-01", "a")]
    df = spark.createDataFrame(rows, "folder string, file string, size int, day string, key string")
    kept, report = files.deduplicated(df)
    assert sorted(tuple(r) for r in kept.collect()) == sorted([rows[0], rows[1], rows[3], rows[5]])
    assert {(r.folder, r.file): (r.rows, r.dropped, r.archived) for r in report.collect()} == {("f", "long"): (2, 0, False), ("f", "short"): (2, 1, False), ("f", "copy"): (2, 2, True), ("g", "short"): (1, 0, False)}
    again, more = files.deduplicated(kept)
    assert again.count() == 4 and more.agg(F.sum("dropped")).first()[0] == 0


def test_first_fresh_source(spark):
    quotes = spark.createDataFrame([("A", "x", "2024-01-01"), ("A", "y", "2024-02-01"), ("A", "z", "2024-02-02"), ("B", "x", "2024-01-01")], "commodity string, source string, date string")
    order = spark.createDataFrame([("A", "x", 1), ("A", "z", 3), ("A", "y", 2), ("B", "x", 1), ("C", "x", 1)], "commodity string, source string, ord int")
    assert [tuple(r) for r in prices.first_fresh(quotes, order, "2024-02-03", 3).collect()] == [("A", "y", "2024-02-01")]
    assert sorted(tuple(r) for r in prices.stale(quotes, order, "2024-02-03", 3).collect()) == [("B", 1), ("C", 1)]


def test_price_files(spark, tmp_path):
    path = str(tmp_path / "prices")
    rows = lambda *x: spark.createDataFrame(x, "commodity string, date string, price double, quote string")
    prices.upsert(spark, rows(("A", "2024-01-02", 2.0, "USD"), ("A", "2024-01-01", 1.5, "USD"), ("B", "2024-01-01", 7.0, "USD")), path)
    old = {p: p.stat().st_mtime_ns for p in (tmp_path / "prices").glob("of=B/*.txt")}
    prices.upsert(spark, rows(("A", "2024-01-02", 3.0, "USD"), ("A", "2024-01-03", 4.0, "USD")), path)
    found = sorted(tuple(r) for r in price_lines(spark.read.text(path).select("value")).collect())
    assert found == [("A", "2024-01-01", 1.5, "USD"), ("A", "2024-01-02", 3.0, "USD"), ("A", "2024-01-03", 4.0, "USD"), ("B", "2024-01-01", 7.0, "USD")]
    assert old == {p: p.stat().st_mtime_ns for p in (tmp_path / "prices").glob("of=B/*.txt")}


def test_chain_records(spark):
    columns = "tx string, wallet string, asset string, contract string, sender string, receiver string, value long, direction string"
    base = spark.createDataFrame([
        ("t", "w", "SOL", None, "ata", "w", 5, "in"), ("t", "w", "SOL", None, "other", "w", 5, "in"), ("u", "w", "SOL", None, "ata", "w", 5, "in"), ("t", "w", "ABC", None, "p", "w", 9, "in"),
        ("t", "w", "DUP", None, "p", "w", 1, "in"), ("t", "w", "DUP", None, "q", "w", 1, "in"),
    ], columns)
    closes = spark.createDataFrame([("t", "ata", "w", "w"), ("u", "ata", "w", "elsewhere")], "tx string, account string, owner string, destination string")
    held = spark.createDataFrame([("t", "ata", "WSOL"), ("u", "ata", "WSOL")], "tx string, account string, mint string")
    kept = chain_records.without_closes(base, closes, held, "SOL", "WSOL")
    assert sorted((r.tx, r.sender) for r in kept.where("asset = 'SOL'").collect()) == [("t", "other"), ("u", "ata")] and kept.count() == 5
    extra = spark.createDataFrame([("t", "w", "ABC", "0xabc", "p", "w", 9, "in")] + [("t", "w", "DUP", f"0x{k}", "p", "w", 1, "in") for k in range(3)] + [("v", "w", "NEW", "0x9", "p", "w", 2, "out")], columns)
    rich = chain_records.enriched(base, extra, ["contract"])
    assert {(r.asset, r.contract) for r in rich.where("contract is not null").collect()} == {("ABC", "0xabc")} and rich.count() == 6
    whole = chain_records.merged(base, extra, ["contract"])
    assert sorted(r.asset for r in whole.collect()) == ["ABC", "DUP", "DUP", "DUP", "NEW", "SOL", "SOL", "SOL"]
    entries = lambda *x: spark.createDataFrame(x, "tx string, account string, mint string, owner string, decimals int, amount string")
    state = chain_records.account_state(entries(("t", "a", "M", "w", 6, "10"), ("t", "b", "M", None, None, "3")), entries(("t", "a", "M", "v", None, "4"), ("t", "c", "N", "w", 0, None)))
    assert sorted((r.account, r.owner, r.decimals, int(r.pre), int(r.post)) for r in state.collect()) == [("a", "v", 6, 10, 4), ("b", None, None, 3, 0), ("c", "w", 0, 0, 0)]


def test_losses_are_carried(spark):
    rng = random.Random(5)
    years = [(k, fy, rng.randrange(100) * 1.0, rng.randrange(100) * 1.0, rng.randrange(160) * 1.0) for k in "abc" for fy in range(2000, 2012) if rng.random() < 0.8]
    due = []
    for key in "abc":
        carried = 0.0
        for _, fy, short, long, losses in (y for y in years if y[0] == key):
            left = losses + carried
            short, left = short - min(short, left), left - min(short, left)
            long, left = long - min(long, left), left - min(long, left)
            due.append((key, fy, short + long * 0.5, losses + carried - left, left))
            carried = left
    df = spark.createDataFrame(years, "key string, fy int, short double, long double, losses double").repartition(4)
    assert sorted(tuple(r) for r in valuation.loss_carry(df, 0.5).collect()) == due
    assert valuation.loss_carry(df.limit(0), 0.5).count() == 0


@pytest.mark.parametrize(("gains", "saved"), [((100.0, 0.0, 0.0), (50.0, 0.0, 15.0)), ((20.0, 100.0, 0.0), (50.0, 0.0, 10.5)), ((20.0, 10.0, 25.0), (5.0, 45.0, 0.75))])
def test_harvest(spark, gains, saved):
    parcels = spark.createDataFrame([(1.0, 90.0, 60.0), (1.0, 30.0, 10.0), (1.0, 5.0, 50.0)], "left double, cost double, value double")
    r = valuation.harvest(parcels, *map(F.lit, gains), 0.5, 0.3).first()
    assert (r.realisable, r.parcels) == (50.0, 3) and (r.offset, r.carried, r.saved) == pytest.approx(saved)


def test_number_formats(spark):
    rows = [(0.0, None), (123.456, None), (-0.0034, None), (0.00001, None), (1e-12, None), (1.5, 4), (0.001, 2), (1150774.25, 0)]
    df = spark.createDataFrame(rows, "x double, d int")
    found = df.select(formats.smart(F.col("x")).alias("s"), formats.amount_of(F.col("x"), F.col("d")).alias("a"), formats.money(F.col("x")).alias("m")).collect()
    assert [r.s for r in found] == ["0.00", "123.46", "-0.0034", "0.000010", "0.0000000000", "1.50", "0.0010", "1150774.25"]
    assert [r.a for r in found][5:] == ["1.5000", "0.0010", "1150774"] and found[7].m == "1,150,774.25" and found[0].m == "0.00"


def test_manual_ledgers(spark):
    legs = "array<struct<account: string, amount: double, commodity: string>>"
    rows = [("2024-01-01", "A", None, None, [("a", 1.0, "X")])] * 3 + [("2024-01-01", "A", None, "src:1", [("a", 1.0, "X")]), ("2024-01-02", "B", "n", "txn:7, src:2", []), ("2024-01-02", "B", "n", "src:mytxn:3", [])]
    df = spark.createDataFrame(rows, f"date string, payee string, narration string, meta string, postings {legs}")
    metas = lambda d: sorted(r.meta for r in manual.with_ids(d).collect())
    found = metas(df)
    assert found == metas(df.repartition(3)) == metas(manual.with_ids(df)) and len(set(found)) == 6 and "txn:7, src:2" in found
    same = [m for m in found if m.endswith("-2") or m.endswith("-3")]
    assert len(same) == 2 and same[0][:-2] == same[1][:-2] and same[0][:-2] in found
    ignored = spark.createDataFrame([("txn:7",), ("c:1",), ("",), (None,), ("longer than any meta of all these",)], "id string")
    assert sorted(str(r.meta) for r in manual.without_ignored(df, ignored).collect()) == ["None"] * 3 + ["src:mytxn:3"]
    assert manual.without_ignored(df, ignored.limit(0)).count() == 6


def test_base_units_of_any_length(spark):
    units = ["1", "123456", "0", "9" * 150]
    found = spark.createDataFrame([(u,) for u in units], "u string").select(scalars.from_base_units(F.col("u"), 6).alias("x")).collect()
    assert [r.x for r in found] == ["0.000001", "0.123456", "0.000000", "9" * 144 + "." + "9" * 6]
