"""What queries return over whole tables, against DuckDB SQL or plain loops that share no code with them."""

import hashlib
import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from pennyworks.llm import embedding_dedup, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


URLS = """
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
raw AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
part AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM raw),
rules(rule, host, path, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM part p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY 1)
SELECT page_id, host, path, rule, verdict FROM part LEFT JOIN fit USING (page_id) ORDER BY page_id
"""


def test_hosts_paths_and_rules_equal_sql(spark, db):
    due = db.sql(URLS).fetchall()
    found = queries.op2_url_rules(spark, SF).orderBy("page_id").select("page_id", "host", "path", "rule", "verdict").collect()
    assert len(found) == len(due) > 0
    for got, want in zip(found, due):
        assert tuple(got)[:4] == want[:4]
        assert got.verdict == want[4] if want[3] else got.verdict in ("allow", "block")
    assert len({row[3] for row in due}) > 2


def test_numbers_of_shingles_equal_sql(spark, db):
    due = db.sql(r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)
        SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]))) END FROM w ORDER BY 1
    """).fetchall()
    found = queries.op5_ngram_jaccard(spark, SF).orderBy("doc_id").select("doc_id", "n_shingles").collect()
    assert [tuple(r) for r in found] == due


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


#: The kinds as the contract lists them.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    for n, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fails = {
                "email": False, "ip": any(int(p) > 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": not (14 <= len(digits) <= 19 and luhn(digits)), "phone": not 10 <= len(digits) <= 15,
            }
            if not fails[kind]:
                found.append((m.start(), n, m.end(), kind))
    return [(start, end, kind) for start, _, end, kind in sorted(found)]


def test_base_spans_of_all_documents_equal_plain_patterns(spark, db):
    texts = dict(db.sql("SELECT doc_id, COALESCE(text, '') FROM documents").fetchall())
    found = queries.op6_pii(spark, SF).collect()
    assert len(found) == len(texts)
    seen = dict.fromkeys(KINDS, 0)
    for r in found:
        due = base_spans(texts[r.doc_id])
        joined = ",".join(f"{kind}:{start}:{end}" for start, end, kind in due)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        for kind in KINDS:
            n = sum(k == kind for _, _, k in due)
            assert r[f"n_{kind}"] == n
            seen[kind] += n
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
    assert all(seen.values()), seen


def test_counts_of_words_lines_and_symbols_equal_a_loop(spark, db):
    texts = dict(db.sql("SELECT doc_id, COALESCE(text, '') FROM documents").fetchall())
    for r in queries.op8_weak_quality_rules(spark, SF).collect():
        text = texts[r.doc_id]
        words = re.findall("[^\x20\x09-\x0d]+", text)
        lines = text.split("\n")
        dup = sum(bool(re.search("[^\x20\x09-\x0d]", line)) and line in seen for line, seen in ((line, set(lines[:k])) for k, line in enumerate(lines)))
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = {}
        for w in windows:
            often[w] = often.get(w, 0) + 1
        repeated = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(5)}
        due = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == due
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        assert r.base_failed == failed and not (failed and r.kept)


def test_personal_data_without_counted_characters(spark):
    import corpus_pipeline

    rows = [(1, "mail a@b.de now", 5), (2, None, None), (3, "", 7), (1, "mail a@b.de now", 5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, kind int")
    found = [tuple(r) for r in corpus_pipeline.personal_data(spark, docs, "").collect()]
    due = (1, "mail <EMAIL> now", 5)
    assert sorted(found, key=repr) == sorted([due, (2, None, None), (3, "", 7), due], key=repr)
    assert corpus_pipeline.personal_data(spark, docs.where("false"), "").collect() == []
    counted = corpus_pipeline.personal_data(spark, docs.withColumn("n_chars", docs.kind.cast("long")), "")
    assert sorted((r.doc_id, r.n_chars) for r in counted.where("text is not null").collect()) == [(1, 16), (1, 16), (3, 0)]


def test_only_rows_that_may_meet_in_a_cell_are_dealt_together(spark):
    guests = [0] * 5 + [1] * 9 + [2] * 4 + [3] * 3
    rows = [("a", 4, 7, n, 1, g, b"") for n, g in enumerate(guests)] + [("a", 4, 8, 90 + n, 1, 1, b"") for n in range(6)]
    cells = spark.createDataFrame(rows, "label string, dim int, cell long, node long, copies long, guest byte, unit binary")
    blocks = {}
    for r in embedding_dedup._dealt(cells, 2).collect():
        blocks.setdefault((r.cell, r.of, r.i, r.to, r.j), []).append((r.first, r.node))
    met = Counter()
    for (_, of, i, to, j), held in blocks.items():
        left = [n for first, n in held if first]
        right = [n for first, n in held if not first]
        met.update(frozenset(p) for p in (itertools.combinations(left, 2) if (of, i) == (to, j) else itertools.product(left, right)))
    assert met == {frozenset((a, b)): 1 for a, b in itertools.combinations(range(len(guests)), 2) if not guests[a] & guests[b]}


def test_tiles_link_what_double_precision_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    x[30:] = x[:30] + rng.normal(size=(30, 8)) * 0.2
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.93
    np.fill_diagonal(linked, False)
    pdf = pd.DataFrame({"unit": [u.tobytes() for u in unit], "node": np.arange(60), "copies": 1, "first": True, "of": 0, "i": 0, "to": 0, "j": 0})
    found = embedding_dedup._blocks(0.93)(pdf)
    assert found.groupby("node")["links"].sum().to_dict() == {k: n for k, n in enumerate(linked.sum(axis=1)) if n}
    half = pdf.assign(first=np.arange(60) < 25, j=1)
    cut = linked.copy()
    cut[:25, :25] = cut[25:, 25:] = False
    assert embedding_dedup._blocks(0.93)(half).groupby("node")["links"].sum().to_dict() == {k: n for k, n in enumerate(cut.sum(axis=1)) if n}
