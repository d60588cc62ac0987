"""Suggestions, siblings, pooled swaps, CSV mappings and the store, against plain loops and round trips."""

import random

import pytest
from pyspark.sql import functions as F

from pennyworks.operators import groups, issues, partners, prices
from pennyworks.plans import swap_queries
from pennyworks.sources import csv_rows, store

SF = "/root/testdata/sf0.001"
LEG = "id string, account string, at string, commodity string, amount double, payee string, src string, value double, n int"


def loop(rows, seconds=60, least=0.2):
    """Every leg in order of time against all later ones."""
    import datetime

    when = lambda r: datetime.datetime.fromisoformat(r.at)
    rows, used, found = sorted((r for r in rows if r.id is not None), key=lambda r: (when(r), r.n)), set(), set()
    for i, a in enumerate(rows):
        if i in used:
            continue
        fit = []
        for j in range(i + 1, len(rows)):
            b = rows[j]
            opposite = abs(a.amount) > 1e-9 and abs(b.amount) > 1e-9 and a.amount * b.amount < 0
            near = (when(b) - when(a)).total_seconds() <= seconds
            if j not in used and near and a.commodity != b.commodity and ((opposite and a.account == b.account) or (a.src is not None and a.src == b.src)):
                fit.append(j)
        if not fit:
            continue
        j = next((j for j in fit if a.payee and rows[j].payee == a.payee), fit[0])
        b = rows[j]
        if a.value is not None and b.value is not None and max(a.value, b.value) > 0 and min(a.value, b.value) / max(a.value, b.value) < least:
            continue
        used |= {i, j}
        found.add((a.id, b.id) if a.amount < 0 else (b.id, a.id))
    return found


def test_suggestions_equal_a_loop(spark):
    import random

    draw, rows = random.Random(5), []
    for n in range(600):
        at = f"2024-03-{1 + n // 300:02d} {draw.randrange(24):02d}:{draw.randrange(60):02d}:{draw.randrange(60):02d}"
        amount = draw.choice([-2.0, -1.0, 1.0, 3.0, 0.0])
        rows.append((f"t{n}" if n % 50 else None, draw.choice(["a", "b"]), at, draw.choice("XYZ"), amount, draw.choice([None, "", "p", "q"]), draw.choice([None, None, "s1", "s2"]), draw.choice([None, 0.0, 1.0, 9.0]), n))
    legs = spark.createDataFrame(rows, LEG).repartition(5)
    found = [tuple(r) for r in partners.suggest(legs, ["n", "id"], seconds=300).collect()]
    due = loop(legs.collect(), seconds=300)
    assert len(found) == len(due) > 20 and set(found) == due


def test_suggestions_across_accounts_follow_a_chain_of_sources(spark):
    """Ten accounts that meet only through sources, in a chain, within an account too."""
    rows = [(f"a{k}", f"acc{k}", "2024-01-01 00:00:00", "X", -1.0, None, f"s{k}", None, 2 * k) for k in range(10)]
    rows += [(f"b{k}", f"acc{k + 1}", "2024-01-01 00:00:30", "Y", 1.0, None, f"s{k}", None, 2 * k + 1) for k in range(10)]
    rows += [("late", "acc99", "2024-01-01 00:01:11", "Z", 1.0, None, "s0", None, 99), ("no", "acc98", "2024-01-01 00:00:10", "X", 1.0, None, "s0", None, 98)]
    legs = spark.createDataFrame(rows, LEG).repartition(4)
    found = {tuple(r) for r in partners.suggest(legs, ["n", "id"]).collect()}
    assert found == loop(legs.collect())
    assert len(found) == 10 and all("late" not in pair for pair in found)
    empty = legs.where("false")
    assert partners.suggest(empty, ["n", "id"]).collect() == []


def test_connected_nodes_have_the_least_as_root(spark):
    import random

    draw = random.Random(3)
    pairs = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 5000 + k) for k in range(1, 60)] + [(7, 7)]
    root = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    found = {r.node: r.root for r in groups.connected(spark.createDataFrame(pairs, "a int, b int")).collect()}
    nodes = {x for pair in pairs for x in pair}
    assert found == {x: top(x) for x in nodes if top(x) != x}
    assert groups.connected(spark.createDataFrame([], "a int, b int")).collect() == []


def test_suggestions_of_the_tables_equal_a_loop(spark):
    legs = swap_queries.suggestion_legs(spark, SF).orderBy("l_orderkey", "l_linenumber", "id").withColumn("n", F.monotonically_increasing_id())
    by_account = {}
    for r in legs.collect():
        by_account.setdefault((r.account, r.at), []).append(r)
    found = {tuple(r) for r in swap_queries.trade_suggest(spark, SF).collect()}
    assert found == set().union(*(loop(rows) for rows in by_account.values()))


def test_siblings_take_the_first_way_that_there_is(spark):
    rows = [
        ("d1", "sell", "A", 5.0, 1, "x1", "x9"), ("d1", "sell", "A", 2.0, 2, "x2", None), ("d1", "buy", "B", 1.0, 3, "x3", None), ("d1", "buy", "B", 7.0, 4, "x4", None),
        ("d2", "sell", "A", 5.0, 5, "x5", None), ("d2", "buy", "B", 1.0, 6, "x6", None), ("d2", "buy", "B", 2.0, 7, "x7", None),
        ("d3", "sell", "A", 5.0, 8, "x8", None), ("d3", "sell", "A", 1.0, 9, "x9", None), ("d3", "sell", "B", 6.0, 10, "x10", None), ("d3", "sell", "C", 4.0, 11, "x11", None),
        ("d4", "sell", "A", 1.0, 12, None, None),
    ]
    legs = spark.createDataFrame(rows, "day string, side string, commodity string, size double, n int, id string, ref string")
    found = {r.n: r.sibling and r.sibling.n for r in partners.siblings(legs, ["day"], ["n"]).collect()}
    assert found == {1: 9, 2: 3, 3: 2, 4: 1, 5: 6, 6: 5, 7: 5, 8: 10, 9: 11, 10: 8, 11: 8, 12: None}


def test_csv_mapping(spark):
    rows = spark.createDataFrame(
        [("f", 1, "2024-01-02", "$1,000.50", "shop", "2"), ("f", 2, "2024-01-03", "-5", None, "0.5 EUR"), ("f", 3, None, "1", "x", None), ("f", 4, "2024-01-05", "n/a", "x", None), ("f", 5, "2024-01-06", "7", "hide", "free")],
        "file string, row int, Date string, Amount string, Who string, Cost string",
    )
    mapping = {"date": "Date", "amount": "Amount", "payee": "Who", "fee": "Cost", "skip": "Who = 'hide'"}
    found = csv_rows.transactions(rows, mapping, "assets:bank").orderBy("date").collect()
    legs = [[(p.account, p.amount, p.commodity) for p in r.postings] for r in found]
    assert legs == [
        [("assets:bank", 998.5, "USD"), ("expenses:unknown", -1000.5, "USD"), ("income:trading:fees", 2.0, "USD")],
        [("assets:bank", -5.0, "USD"), ("expenses:unknown", 5.0, "USD"), ("income:trading:fees", 0.5, "EUR")],
    ]
    assert found[0].meta.startswith("txn:csv-") and len({r.meta for r in found}) == 2
    assert csv_rows.transactions(rows.limit(0), mapping, "a").count() == 0
    for bad in ({"date": "Date"}, mapping | {"colour": "1"}):
        with pytest.raises(ValueError):
            csv_rows.transactions(rows, bad, "a")


def test_store_writes_changed_folders_and_reads_those_in_scope(spark, tmp_path):
    path = str(tmp_path / "ledger")
    make = lambda rows: spark.createDataFrame(rows, "account string, folder string, n int, text string")
    plain = lambda df: sorted(map(str, df.select("account", "folder", "n", "text").collect()))
    rows = [("assets:x", "2024", 1, "a"), ("assets:x:y", "02", 2, None), ("assets:xy", "f g", 3, ""), (None, "k", 4, "z"), ("assets:old", "k", 5, "z")]
    store.update(spark, make(rows), path)
    assert plain(store.load(spark, path)) == plain(make(rows))
    files = lambda f: {x.name for x in (tmp_path / "ledger" / "txns").rglob("*.parquet") if f in str(x)}
    before, changed = files("folder=2024"), files("folder=02")
    rows = [*rows[:1], ("assets:x:y", "02", 2, "now"), *rows[2:4], ("new", "k", 6, "n")]
    store.update(spark, make(rows), path)
    assert plain(store.load(spark, path)) == plain(make(rows))
    assert files("folder=2024") == before and files("folder=02") != changed
    scoped = store.load(spark, path, "assets:x")
    assert plain(scoped) == plain(make(rows[:2]))
    assert "PartitionFilters: [isnotnull(account" in scoped._jdf.queryExecution().toString() or "StartsWith" in scoped._jdf.queryExecution().toString()
    assert {(r.account, r.n) for r in store.summary(spark, path).collect()} == {("assets:x", 1), ("assets:x:y", 1), ("assets:xy", 1), (None, 1), ("new", 1)}
    store.update(spark, make([]), path)
    assert store.load(spark, path).count() == 0


def test_as_of_over_months_without_prices(spark):
    quotes = spark.createDataFrame([("A", "2024-01-10", 1.0, "U"), ("A", "2024-01-20", 2.0, "U"), ("A", "2024-05-05", 3.0, "U"), (None, "2024-01-01", 9.0, "U"), ("A", "soon", 9.0, "U")], "commodity string, date string, price double, quote string")
    days = ["2023-12-31", "2024-01-09", "2024-01-10", "2024-01-25", "2024-03-01", "2024-05-04", "2024-05-05", "2031-01-01", None, "never"]
    asked = spark.createDataFrame([(d,) for d in days], "day string").withColumn("c", F.lit("A"))
    for first, due in ((False, [None, None, 1.0, 2.0, 2.0, 2.0, 3.0, 3.0, None, None]), (True, [1.0, 1.0, 1.0, 2.0, 2.0, 2.0, 3.0, 3.0, None, None])):
        found = {r.day: r.p and r.p.price for r in prices.as_of(asked, quotes, "c", "day", "p", first_if_none=first).collect()}
        assert found == dict(zip(days, due))


def test_issue_messages(spark):
    found = spark.createDataFrame([("file:/a/b/2020.ledger", 0, 7, "x", "bad date")], "file string, chunk int, n int, value string, problem string")
    assert [tuple(r) for r in issues.parse_messages(found).collect()] == [("Parse Errors", "error", None, "line 0.7 — bad date (2020.ledger)")]
    txns = spark.createDataFrame([("2020-01-02", None, "n", 2), ("2020-01-01", "p", None, 1)], "date string, payee string, narration string, k int")
    texts = lambda df: [r.message for r in df.collect()]
    assert sorted(texts(issues.uncategorised_messages(txns, ["k"], most=1))) == ["...and 1 more", "2 uncategorised transactions", "2020-01-01 p — "]
    assert texts(issues.uncategorised_messages(txns.where("k = 2"), ["k"])) == ["1 uncategorised transaction", "2020-01-02  — n"]
    assert texts(issues.uncategorised_messages(txns.where("false"), ["k"])) == []
    warnings = spark.createDataFrame([("a:b: c",), ("plain",), (None,)], "warning string")
    assert {(r.label, r.message) for r in issues.warning_messages(warnings).collect()} == {("a", "b: c"), ("Other", "plain"), ("Other", None)}
    legs = spark.createDataFrame([("s", "2020-01-01 10:00:00", "BTC", -0.5), ("b", "2020-01-01 10:00:30", "AUD", 1000.0)], "id string, at string, commodity string, amount double")
    pairs = spark.createDataFrame([("s", "b")], "sell string, buy string")
    assert texts(issues.suggestion_messages(pairs, legs)) == ["2020-01-01 0.5 BTC → 1000 AUD"]
    postings = spark.createDataFrame([("2020-01-01", "a:x", "N"), ("2020-01-03", "a:w", "N"), ("2020-01-02", "a:x", "AUD"), ("2020-01-02", "a:x", ""), ("2020-01-02", "a:x", None), ("2020-01-05", "a:x", "P")], "date string, account string, commodity string")
    quotes = spark.createDataFrame([("P", "2020-01-04", 2.0, "AUD")], "commodity string, date string, price double, quote string")
    assert texts(issues.unpriced_messages(postings, quotes, "AUD")) == ["N — 2 postings, 2020-01-01 → 2020-01-03 (a:w, a:x)"]


def test_pooled_swaps_are_dealt_by_their_number(spark, monkeypatch):
    """A task's share does not grow with the legs; nulls meet nothing; partners equal a loop over all pairs."""
    import random

    draw = random.Random(9)
    rows = [(draw.choice(["d1", "d2", None]), draw.choice(["X", "Y", "Z", None]), k // 3, float(draw.choice([-3, -2, -1, 0, 1, 2, 4]))) for k in range(240)]
    monkeypatch.setattr(partners, "ROWS", 10)
    found = partners.pooled_swaps(spark.createDataFrame(rows, "day string, commodity string, txn int, amount double"), ["day"], ["txn"])
    assert found.rdd.getNumPartitions() > 8
    totals, ranked = {}, {}
    for day, commodity, txn, amount in rows:
        if amount and day and commodity:
            key = (day, "sell" if amount < 0 else "buy", commodity)
            totals.setdefault(key, {})[txn] = totals.get(key, {}).get(txn, 0) + abs(amount)
    for key, sums in totals.items():
        for k, (total, txn) in enumerate(sorted((v, t) for t, v in sums.items())):
            ranked[(*key, k)] = (total, txn)
    due = set()
    for (day, side, commodity, k), (total, txn) in ranked.items():
        others = [(c, *v) for (d, s, c, j), v in ranked.items() if (d, j) == (day, k) and s != side and c != commodity]
        if others:
            due.add((day, side, commodity, txn, total, max(others), max(others)[1] / total))
    assert {(r.day, r.side, r.commodity, r.txn, r.total, tuple(r.partner), r.unit) for r in found.collect()} == due and len(due) == found.count() > 40


def test_only_times_are_ordered_to_cut_accounts(spark, monkeypatch):
    """An account's legs of one time are a row where it is cut, however many they are."""
    seen, sessions = [], partners.links.sessions
    monkeypatch.setattr(partners.links, "sessions", lambda rows, *rest: (seen.append(rows.count()), sessions(rows, *rest))[1])
    rows = [(f"t{k}", f"acc{k % 2}", f"2024-01-01 00:{k % 6 // 2 * 10:02d}:00", "XY"[k % 4 // 2], [1.0, -1.0][k // 2 % 2], None, "s", None, k) for k in range(120)]
    found = partners.suggest(spark.createDataFrame(rows, LEG), ["n", "id"]).count()
    assert seen == [6, 6] and found > 20


def _sibling(leg, legs):
    """The sibling of (day, side, commodity, size, n, id, ref) by a plain reading of the rules."""
    by_size = lambda rows: sorted(rows, key=lambda r: (r[3], r[4]))
    if leg[6] is not None and (named := [r[4] for r in legs if r[5] == leg[6]]):
        return min(named)
    here = [r for r in legs if r[0] == leg[0]]
    other = [r for r in here if r[1] != leg[1]]
    own = [r for r in here if r[1] == leg[1] and r[2] == leg[2]]
    if len(own) == len(other) > 1:
        return by_size(other)[by_size(own).index(leg)][4]
    if other:
        return min(r[4] for r in other)
    own, rest = [r for r in here if r[2] == leg[2]], [r for r in here if r[2] != leg[2]]
    if len(own) == len(rest) > 1:
        return by_size(rest)[by_size(own).index(leg)][4]
    return min((r[4] for r in rest), default=None)


def test_siblings_equal_a_loop_and_only_legs_with_a_rank_meet_again(spark):
    draw, rows = random.Random(11), []
    for day in range(60):
        sides = ["sell"] if day % 3 == 0 else ["sell", "buy"]
        for _ in range(draw.choice([1, 2, 4, 6])):
            n = len(rows)
            rows.append((f"d{day}", draw.choice(sides), draw.choice("AB" if day % 2 else "ABC"), float(draw.randint(1, 3)), n, f"x{n // 2}", f"x{draw.randint(0, 80)}" if draw.random() < 0.2 else None))
    legs = spark.createDataFrame(rows, "day string, side string, commodity string, size double, n int, id string, ref string")
    found = partners.siblings(legs, ["day"], ["n"], ["n", "ref"])
    assert found.columns == ["n", "ref", "sibling"]
    assert {r.n: r.sibling and r.sibling.n for r in found.collect()} == {r[4]: _sibling(r, rows) for r in rows}
