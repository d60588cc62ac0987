import hashlib
import random
import zlib
from collections import defaultdict
from decimal import Decimal
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pennyworks.llm import bpe_transducer, embedding_whitening, prefix_trie, queries
from pennyworks.llm.scans import prefix_scan

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, d string, f string, n string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, None, "x", "y") for r in rows], TURNS)


def nodes_of(paths):
    """The trie's rows by plain loops over paths: conv_id -> [(role, text), ...]."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def below(node):
        found, todo = [], [node]
        while todo:
            found.append(todo.pop())
            todo += kids[found[-1]]
        return found

    out = []
    for node, own in members.items():
        sub = below(node)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in sub if x)
        ends = ",".join(map(str, sorted(c for c in own if len(paths[c]) == len(node))))
        up = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), up, len(own), len(kids[node]), sum(not kids[x] for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def paths_of(rows, rebuilt):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    if not rebuilt:
        return own
    cut = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: cut[c]] + own[c][cut[c] :] for c in own}


@pytest.fixture(scope="module")
def talks():
    """Copies, common beginnings, nulls, gaps in the turns, a long conversation and conversations that end within others."""
    rng = random.Random(11)
    rows = []
    for c in [*range(60), *range(100, 130), *range(250, 290), 7_000_000_000, 400, 499]:
        n = rng.randint(1, 7)
        rows += [(c, (None if k == 0 and c % 3 else k * 2 - 5), rng.choice(["user", None, ""]), rng.choice(["a", "b", "", None, "añ" * 9])) for k in range(n)]
    rows += [(c, k, "user", "same") for c in (300, 301, 302, 303) for k in range(3)]
    rows += [(500, k, "user", f"t{k % 3}") for k in range(700)] + [(501, k, "user", f"t{k % 3}") for k in range(650)]
    rows += [(None, 1, "user", "x")] * 3
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("rebuilt", "hash_bits", "base"), [(True, 64, prefix_trie.BASE), (False, 64, prefix_trie.BASE), (True, 2, prefix_trie.BASE), (True, 64, 1)])
def test_trie_equals_brute_force(spark, talks, rebuilt, hash_bits, base):
    rows = [r for r in talks if base != 1 or r[0] not in (500, 501)]  # with sums as fingerprints each depth takes a pass of its own
    found = prefix_trie.trie(conversations(spark, rows).repartition(5), rebuilt, hash_bits, base)
    assert sorted(map(tuple, found.collect()), key=str) == nodes_of(paths_of(rows, rebuilt))


def test_trie_of_nothing_and_of_turnless(spark):
    assert prefix_trie.trie(conversations(spark, [])).count() == 0
    assert prefix_trie.trie(conversations(spark, [(None, 1, "a", "b")]), True).count() == 0
    rows = [(c, 0, "user", "x") for c in range(101, 140)]  # none has conversation 100 to begin with
    assert sorted(map(tuple, prefix_trie.trie(conversations(spark, rows), True).collect()), key=str) == nodes_of(paths_of(rows, True))


def test_trie_of_repeated_rows(spark):
    rows = [(1, 0, "user", "x")] * 3 + [(2, 0, "user", "x")]
    assert sorted(map(tuple, prefix_trie.trie(conversations(spark, rows)).collect()), key=str) == nodes_of(paths_of(rows, False))


def test_trie_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    due = con.execute(queries.ORACLES["op11_prefix_trie"])
    names = [c[0] for c in due.description]
    found = queries.op11_prefix_trie(spark, SF)
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(tuple, found.select(*names).collect()), key=str) == sorted(due.fetchall(), key=str)


def test_blocks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_IDS", 3)
    rows = [(c, 0, "user", "x") for c in range(1, 50)]
    assert sorted(map(tuple, prefix_trie.trie(conversations(spark, rows)).collect()), key=str) == nodes_of(paths_of(rows, False))


@pytest.mark.parametrize("base", [1, 0x9E3779B97F4A7C15])
def test_scan_over_ranges(spark, base):
    rng = random.Random(2)
    rows = [(5 if k % 3 else rng.randrange(9), k, rng.randrange(-(1 << 63), 1 << 63)) for k in range(3000)]
    found = prefix_scan(spark.createDataFrame(rows, "k long, at long, v long").repartition(6), "k", ["at"], "v", "scan", base).collect()
    signed = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    state, due = {}, {}
    for k, at, v in sorted(rows):
        d, h = state.get(k, (0, 0))
        state[k] = d + 1, h * base + v
        due[at] = (d + 1, signed(h * base + v), signed(h))
    assert {r["at"]: (r.d, r.h, r.p) for r in found} == due


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_transducer.read_ranks(), special_tokens={})


def digest(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_ids_of_all_documents(spark, library):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op12_bpe_transducer(spark, SF).collect():
        ids = library.encode_ordinary(rows[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(ids), hashlib.sha256(rows[r.doc_id].encode()).hexdigest())


def test_ids_of_any_text(library):
    """Random pieces of all kinds of characters, long runs, and with so few arcs remembered that they are often forgotten."""
    import public_tokenizers

    rng = random.Random(4)
    kinds = ["ab ", "aeiou", " \t\n", "0123456789", "'sdtrevm", "é漢字🙂ß", "-=_.*", "\x00\x1c\x85 　"]
    texts = ["".join(rng.choices(rng.choice(kinds) + rng.choice(kinds), k=rng.randint(1, 90))) for _ in range(1500)]
    texts += ["a" * 5000, " " * 5000 + "x", "-" * 3001, "xyz" * 900, "é" * 1000]
    for most in (bpe_transducer.MOST_ARCS, 50):
        encoder = bpe_transducer.Encoder(bpe_transducer.read_ranks(), public_tokenizers.PATTERN, most)
        assert [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts] == [library.encode_ordinary(t) for t in texts]
        assert len(encoder.transducer.arcs) <= most and len(encoder.known) <= most


def test_tokens_leave_after_bounded_lookahead():
    ranks = bpe_transducer.read_ranks()
    machine, longest = bpe_transducer.Transducer(ranks), max(map(len, ranks))
    read = 0

    def feed(raw):
        nonlocal read
        for read, byte in enumerate(raw, 1):  # noqa: B007
            yield byte

    spelt = 0
    for token in machine.run(feed(b"inter-nation-al is a ti on " * 200)):
        spelt += len(machine.spelling[token])
        assert spelt <= read <= spelt + longest


def test_improper_ranks(library):
    """A token that no merges make is only met as a whole piece."""
    ranks = {bytes((b,)): b for b in range(256)} | {b"ab": 256, b"abcd": 257}
    encoder = bpe_transducer.Encoder(ranks, r"\S+|\s+")
    assert list(memoryview(encoder.encode("abcd")).cast("I")) == [257]
    assert list(memoryview(encoder.encode("abcde")).cast("I")) == [256, 99, 100, 101]


def test_utf8_state_machine():
    decoder = bpe_transducer.Decoder(dict(enumerate([bytes((b,)) for b in range(256)] + [b"a\xc3", b"\xa9\xe6\xbc", b"\xa2b", b"\xf0\x9f"])))
    rng = random.Random(6)
    for _ in range(3000):
        ids = rng.choices([*range(256, 260), 0x61, 0x80, 0xA2, 0xC3, 0xE0, 0xED, 0xA0, 0xBC, 0xF4, 0x90, 0xF0, 0x9F, 0xFF], k=rng.randint(0, 9))
        raw = b"".join(decoder.spelling[i] for i in ids)
        assert decoder.decode(ids) == "".join(decoder.stream(ids)) == raw.decode(errors="replace")
    assert list(decoder.stream([256, 257, 258])) == ["a", "é", "\u6f22b"]


def test_bpe_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "a b", "z"), (2, "a b", "z")], "doc_id long, text string, ids string")
    encoded = bpe_transducer.encode(docs)
    assert sorted((r.doc_id or 0, len(r.ids)) for r in encoded.collect()) == [(0, 0), (1, 0), (2, 2), (2, 2)]
    assert sorted(r.decoded for r in bpe_transducer.decode(encoded).collect()) == ["", "", "a b", "a b"]
    odd = spark.createDataFrame([([64, None, 99999999],), (None,)], "ids array<int>")
    assert [r.decoded for r in bpe_transducer.decode(odd).collect()] == ["a��", ""]
    assert bpe_transducer.decode(bpe_transducer.encode(docs.limit(0))).count() == 0
    assert {(r.text or "", r.decoded, tuple(np.frombuffer(r.packed, "<u4"))) for r in bpe_transducer.encode(docs, back=True).collect()} == {("", "", ()), ("a b", "a b", (64, 275))}


def embeddings(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 7) for i, v in rows], "vec_id long, embedding array<double>, n string, component int")


def scaled(v):
    return [int(np.floor(1024 * x)) + 100_000 for x in v]


@pytest.mark.parametrize("shift", [embedding_whitening.OFFSET, 0, -(1 << 50)])
@pytest.mark.parametrize("size", [1.0, 1e9])
def test_whitening_equals_exact_arithmetic(spark, shift, size):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(150, 12)) @ rng.normal(size=(12, 12)) * size + 1e6 * size
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(900, None), (901, [1.0] * 11 + [None]), (902, [1.0] * 11 + [float("nan")]), (903, [float("inf")] + [0.0] * 11), (904, [0.5]), (3, vectors[3].tolist())]
    kept = [(k, v) for k, v in rows if k < 900]
    x = [scaled(v) for _, v in kept]
    n, dims = len(x), 12
    sums = [sum(r[j] for r in x) for j in range(dims)]
    exact = [[sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x) for j in range(dims)] for i in range(dims)]
    covariance = np.array([[float(Fraction(t, n**3)) for t in row] for row in exact])
    found = embedding_whitening.whiten(embeddings(spark, rows).repartition(4), shift).collect()
    assert len(found) == n * 8 and {r.n for r in found} == {n}
    deviation = {k: sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for (k, _), r in zip(kept, x, strict=True)}
    assert all(r.deviation == Decimal(deviation[r.vec_id]) for r in found)
    values, directions = np.linalg.eigh(covariance)
    off = {k: np.array([float(Fraction(n * a - s, n)) for a, s in zip(r, sums, strict=True)]) for (k, _), r in zip(kept, x, strict=True)}
    due = {k: v @ directions[:, ::-1] / np.sqrt(values[::-1]) for k, v in off.items()}
    signs = {}
    for r in found:
        want = due[r.vec_id][r.component - 1]
        signs.setdefault(r.component, np.sign(r.whitened * want) if abs(want) > 0.1 else None)
        if signs[r.component] is None:
            del signs[r.component]
            continue
        assert abs(r.whitened * signs[r.component] - want) < 1e-6
        assert abs(r.explained / (values[::-1][r.component - 1] / values.sum()) - 1) < 1e-9
        assert r.identity_error < 1e-9


def test_whitening_of_the_table(spark):
    found = queries.op13_embedding_whitening(spark, SF)
    assert found.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and dict(found.dtypes)["deviation"] == "bigint"
    wide = found.groupBy("vec_id").pivot("component", list(range(1, 9))).agg(F.first("whitened")).toPandas().drop(columns="vec_id").to_numpy()
    assert np.abs(wide.T @ wide / len(wide) - np.eye(8)).max() < 1e-9 and np.abs(wide.mean(axis=0)).max() < 1e-9


def test_whitening_without_variance(spark):
    assert embedding_whitening.whiten(embeddings(spark, [])).count() == 0
    assert embedding_whitening.whiten(embeddings(spark, [(1, None), (2, [None])])).count() == 0
    assert embedding_whitening.whiten(embeddings(spark, [(1, [1, 2]), (1, [1, 2])])).count() == 0
    line = embedding_whitening.whiten(embeddings(spark, [(None, [1, 2]), (2, [2, 4]), (3, [3, 6])])).collect()
    assert sorted(abs(round(r.whitened, 6)) for r in line) == [0, 1.224745, 1.224745] and {r.component for r in line} == {1}


def test_products_are_exact():
    rng = random.Random(8)
    y = np.array([[rng.randrange(-(1 << 62), 1 << 62) for _ in range(3)] for _ in range(50)])
    due = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)]
    assert embedding_whitening.products(y).tolist() == due
