import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pennyworks.llm import embedding_dedup, html_text, ngram_jaccard, packing, pii, pu_quality, queries, sentencepiece_scan, toxicity_chain, url_rules, weak_quality
from pennyworks.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, score string, n long, label string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    """Nulls, blanks, copies, near copies, a shared passage, a long text and ordinary ones."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    base, passage = text(80), text(40)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "ONE two"), (5, base), (6, base), (7, base + " tail"), (8, text(3000))]
    for k in range(9, 60):
        part = base.split()
        for _ in range(rng.randint(0, 4)):
            part[rng.randrange(80)] = rng.choice(words)
        rows.append((k, " ".join(part)))
    rows += [(k, text(60) + "\n" + passage) for k in range(60, 110)]
    rows += [(110, "Mail Bob.Low@mail.example.com or +1 (017) 555-7713; 10.0.0.1\n10.0.0.1"), (5, base)]
    return rows


def components_of(links, nodes):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    found = connected_components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.component for r in found} == components_of(links, nodes)


@pytest.mark.parametrize("small", [32, 1])
def test_jaccard_equals_brute_force(spark, corpus, small, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "SMALL_TILE", small)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_ROWS", 8)
    sets = {}
    for i, t in corpus:
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    due = components_of(links, sets)
    rows = ngram_jaccard.cluster(documents(spark, corpus).repartition(3)).collect()
    assert sorted(map(tuple, rows)) == sorted((i, len(sets[i]), due[i]) for i, _ in corpus)


def test_jaccard_of_nothing(spark):
    assert ngram_jaccard.cluster(documents(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_jaccard.cluster(documents(spark, [(None, "a b"), (7, "a b")])).orderBy("doc_id").collect()] == [(None, 1, None), (7, 1, 7)]


def test_bitmap_bound_never_undercuts():
    rng = np.random.default_rng(2)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        assert ngram_jaccard.most_overlap(len(a), ngram_jaccard.bitmap(a), len(b), ngram_jaccard.bitmap(b)) >= len(np.intersect1d(a, b))


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 20)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 8))
    x[50:120] = x[:70] + rng.normal(size=(70, 8)) * 0.12
    x[120:130] = x[0]
    rows = [(k, [float(v) for v in x[k]], str(k % 2)) for k in range(150)]
    rows += [(200, None, "0"), (201, [0.0] * 8, "0"), (202, [float("nan")] * 8, "0"), (203, rows[0][1], None), (204, [1.0, None], "0")]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(a, b) for a in range(150) for b in range(a) if a % 2 == b % 2 and unit[a] @ unit[b] >= 0.93]
    due, n = components_of(links, range(150)), collections.Counter(v for pair in links for v in pair)
    found = embedding_dedup.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), block_rows=16).collect()
    assert {tuple(r) for r in found} == {(k, n[k], due[k], due[k] == k) for k in range(150)} | {(k, 0, k, True) for k in range(200, 205)}


def test_embeddings_of_extreme_norms_and_repeated_ids(spark):
    pairs = [[1e-200, 1e-200], [1e-200, 1.01e-200], [1e200, 1e200], [1.0, 1.0], [1.0, 1.01], [1e300, -1e300], [1e-300, -1e-300], [5e-324, 0.0]]
    rows = [(k, v, "a", 9) for k, v in enumerate(pairs)] + [(3, [-1.0, 5.0], "a", 9), (50, [-1.0, 5.0], "a", 9), (None, [1.0, 1.0], "a", 9)]
    found = sorted(map(tuple, embedding_dedup.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, node int")).collect()), key=str)
    due = [(k, 4, 0, k == 0) for k in range(5)] + [(5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True), (3, 1, 3, True), (50, 1, 3, False), (None, 0, None, False)]
    assert found == sorted(due, key=str)
    assert embedding_dedup.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_two_levels_of_cells_equal_brute_force(spark, monkeypatch):
    for name, value in (("CELL_ROWS", 10), ("TOP_CELLS", 4), ("SAMPLE_A_CELL", 40)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6))
    x[100:400] = x[rng.integers(0, 100, 300)] + rng.normal(size=(300, 6)) * 0.2
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = np.triu(unit @ unit.T >= 0.93, 1)
    links = list(zip(*map(list, np.nonzero(linked)), strict=True))
    due, n = components_of(links, range(400)), collections.Counter(v for pair in links for v in pair)
    found = embedding_dedup.cluster(spark.createDataFrame([(k, x[k].tolist(), "a") for k in range(400)], "vec_id long, embedding array<double>, label string"))
    assert {tuple(r) for r in found.collect()} == {(k, n[k], due[k], due[k] == k) for k in range(400)}


def test_ids_are_those_of_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("a <|endoftext|> b", "", "  lead\n\n tail ", "éß漢 don't 12345", "x" * 5000, " " * 6000 + "x", "<|endoftext", "a\u200bb\u00a0c\r\n\tq"):
        assert packing.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_repeated_rows_are_dealt_to_all_shards(spark):
    rows = packing.pack(documents(spark, [(7, "one two three")] * 300).repartition(4), max_tokens=16, shard_pieces=50).collect()
    assert len(rows) == 300 and len({r.sequence_id >> 40 for r in rows}) > 3
    assert all(sorted(r.offset for r in rows if r.sequence_id == s)[0] == 0 for s in {r.sequence_id for r in rows})


def test_packing(spark, corpus):
    rows = packing.pack(documents(spark, corpus), max_tokens=256, shard_pieces=40).collect()
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    ids = {i: np.append(packing.encode(t or ""), 0).astype("<u4") for i, t in corpus}
    assert sum(r.length for r in rows) == sum(len(ids[i]) for i, _ in corpus)
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack(documents(spark, [])).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize(("max_docs", "max_cost"), [(3, None), (None, 2500), (3, 2500), (None, None)])
def test_best_fit_keeps_every_capacity(rule, max_docs, max_cost):
    lengths = np.random.default_rng(3).integers(1, 50, 400)
    sequence, offset = packing.best_fit(lengths, 100, max_docs, max_cost, rule=rule)
    for k in np.unique(sequence):
        own = np.flatnonzero(sequence == k)
        own = own[np.argsort(offset[own])]
        assert (offset[own] == np.cumsum(lengths[own]) - lengths[own]).all() and lengths[own].sum() <= 100
        assert len(own) <= (max_docs or 100) and (lengths[own] ** 2).sum() <= (max_cost or 100**2)
    tens = np.full(12, 10)
    due = max(-(-12 // min(10, max_docs or 10)), -(-12 // min(10, (max_cost or 10**4) // 100)))
    assert len(np.unique(packing.best_fit(tens, 100, max_docs, max_cost, rule=rule)[0])) == due
    assert len(np.unique(packing.best_fit(tens, 100, 5, 200, rule=rule)[0])) == 6


def test_sentencepiece_ids_do_not_depend_on_chunks(spark, corpus):
    """Every chunk size gives the ids of the whole text's best path, found place by place."""
    rows = [*corpus[::7], (None, "x y"), (300, "x" * 999 + "éß漢" * 99), (301, " lead  two\n\n tail "), (302, "aaaa" * 200), (303, "   " * 50 + "a" + " " * 70), (304, "漢"), (305, "the" * 300 + " end")]
    lattice = sentencepiece_scan.lattice()
    due = sorted((str(i), t or "", lattice.path(sentencepiece_scan.escape(t or ""))[1] if t else ()) for i, t in rows)
    for chunk, group in ((10_000, 64), (300, 64), (100, 2), (41, 3), (17, 1)):
        found = sentencepiece_scan.decode(sentencepiece_scan.encode(documents(spark, rows), chunk_chars=chunk, group_chunks=group)).collect()
        assert sorted((str(r.doc_id), r.text or "", tuple(r.ids)) for r in found) == due
        assert all(r.decoded == (r.text or "") for r in found)
    assert sentencepiece_scan.decode(sentencepiece_scan.encode(documents(spark, []))).count() == 0


def test_sentencepiece_path_is_the_best():
    """Against all ways to split short texts."""
    lattice = sentencepiece_scan.lattice()

    def ways(text):
        if not text:
            yield 0
        for length, s in lattice.options(text, 0) if text else ():
            for rest in ways(text[length:]):
                yield s + rest

    for word in ("▁thinking", "▁aaaa", "ß漢x", "▁▁▁no", "▁1234", "hello"):
        assert lattice.path(word)[0] == max(ways(word)) and lattice.solve({word})[word] == lattice.path(word)


def test_max_plus_product_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (rng.integers(-9, 9, (4, 4)) for _ in range(3))
    join = sentencepiece_scan.combine
    assert (join(join(a, b), c) == join(a, join(b, c))).all()


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john.doe(at)mail.example(dot)com now", "email", "john.doe(at)mail.example(dot)com"),
        ("reach bob at example dot com ok", "email", "bob at example dot com"),
        ("ph plus one five five five two three four five six seven eight x", "phone", "plus one five five five two three four five six seven eight"),
        ("ｊohn＠ex​ample.com", "email", "ｊohn＠ex​ample.com"),
        ("call +٠١٢٣٤٥٦٧٨٩٩ x", "phone", "+٠١٢٣٤٥٦٧٨٩٩"),
    ],
)
def test_disguises(text, kind, span):
    base, found = pii.find(text)
    assert base == [] and [(text[s:e], k) for s, e, k in found] == [(span, kind)]


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("no 4111 one one one one 1111 1111 x", "card", "4111 one one one one 1111 1111"),
        ("no Four one one one, 1111, one one one one-1111 x", "card", "Four one one one, 1111, one one one one-1111"),
        ("ph plus one five five five 123 4567 x", "phone", "plus one five five five 123 4567"),
        ("ph PLUS 1 FIVE FIVE FIVE 123 4567 x", "phone", "PLUS 1 FIVE FIVE FIVE 123 4567"),
        ("bob At example Dot com ok", "email", "bob At example Dot com"),
        ("bob at example (dot) com ok", "email", "bob at example (dot) com"),
        ("bob at mail.example dot com ok", "email", "bob at mail.example dot com"),
        ("bob [aT] example{DoT}com ok", "email", "bob [aT] example{DoT}com"),
        ("host 192 dot one six eight dot 0[.]1 x", "ip", "192 dot one six eight dot 0[.]1"),
        ("call +१२३४५６𝟕⑧٩0 x", "phone", "+१२३४५６𝟕⑧٩0"),
        ("𝐛ob@ex⁢ample.ｃom", "email", "𝐛ob@ex⁢ample.ｃom"),
        ("no ｆour one one one 1111 1111 1111 x", "card", "ｆour one one one 1111 1111 1111"),
    ],
)
def test_mixed_disguises(text, kind, span):
    assert [(text[s:e], k) for s, e, k in pii.find(text)[1] if (s, e, k) not in pii.find(text)[0]] == [(span, kind)]


def test_disguises_that_extend_base_spans(spark):
    text = "bob@example.com dot au"
    assert pii.find(text) == ([(0, 15, "email")], [(0, 15, "email"), (0, 22, "email")])
    assert pii.redact(documents(spark, [(1, f"to {text}!")])).first().text == "to <EMAIL>!"
    for t in ("call +1 555 123 4567 one more time", "at 10.0.0.1 one sees", "write at john.doe@example.com", "we met at one dot two", "look at main.py", "sıx sİx ſix seven"):
        base, found = pii.find(t)
        assert base == found
    assert [x[2] for x in pii.find("write at john dot doe at example dot com")[1]] == ["email"]
    pii.find("one " * 50_000 + "dot " * 50_000 + "a at b dot " * 20_000 + "​" * 50_000)  # linear


def test_marks_of_the_text_and_wide_gaps():
    assert pii.find("mail ab (at) example\ue000com") == ([], [])
    assert [x[2] for x in pii.find("mail ab (at) example\ue000com or ab     (   at )   example    dot    com")[1]] == ["email"]
    spelled = "   ,     ".join("four one one one one one one one one one one one one one one one".split())
    assert [x[2] for x in pii.find(f"card {spelled}.")[1]] == ["card"] * pii.luhn("4" + "1" * 15)
    blanks = "a" + " " * 200_000 + "(" + " " * 200_000 + "at"
    assert pii.find(blanks + " one" + " " * 200_000 + "x") == ([], [])


def test_pii_spans(spark, corpus):
    row = pii.spans(documents(spark, corpus)).where("doc_id = 110").first()
    text = corpus[-2][1]
    assert [(text[s.start : s.end], s.kind) for s in row.base] == [("Bob.Low@mail.example.com", "email"), ("+1 (017) 555-7713", "phone"), ("10.0.0.1", "ip"), ("10.0.0.1", "ip")]
    assert pii.find(None) == ([], []) and pii.find("one at two is fine; look at dot points") == ([], [])
    masked = pii.redact(documents(spark, corpus)).where("doc_id = 110").first()
    assert masked.text == "Mail <EMAIL> or <PHONE>; <IP>\n<IP>" and masked.score == "x"
    pii.find("1" * 200_000 + "@" * 1000 + "a" * 200_000)  # linear


def test_quality_counts_equal_brute_force(spark, corpus):
    for r in weak_quality.judge(documents(spark, corpus)).collect():
        t = next(t for i, t in corpus if i == r.doc_id) or ""
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert not (r.base_failed and r.kept)
    assert weak_quality.judge(documents(spark, [])).count() == 0


def test_quality_keeps_every_column(spark, corpus):
    rows = [(i, t, "mine", f"{k}", "w", 3) for k, (i, t) in enumerate(corpus)] + [(None, corpus[8][1], "mine", "z", "w", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _q string, _t string, _W string, score int")
    judged = {r.doc_id: r.kept for r in weak_quality.judge(docs).collect()}
    kept = weak_quality.keep_good(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if judged[r.doc_id])
    marks = spark.createDataFrame([(k, 1) for k in range(5, 110)], "doc_id long, quality int")
    predicted = {r.doc_id: r.predicted for r in pu_quality.classify(docs, marks).collect()}
    good = pu_quality.keep_good(docs, marks)
    assert good.columns == docs.columns and sorted(map(str, good.collect())) == sorted(str(r) for r in docs.collect() if predicted[r.doc_id])
    assert weak_quality.keep_good(docs.limit(0)).count() == 0 == pu_quality.keep_good(docs.limit(0), marks).count()


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(6)
    good = rng.random(40_000) < 0.8
    # How often each rule votes bad on bad and on good documents; the last votes good on bad and on good ones.
    rates = [(0.7, 0.005), (0.6, 0.02), (0.6, 0.04), (0.5, 0.08), (0.15, 0.7)]
    votes = np.array([(rng.random(len(good)) < np.where(good, on_good, on_bad)) * (-1 if k < 4 else 1) for k, (on_bad, on_good) in enumerate(rates)]).T
    patterns = list(collections.Counter(map(tuple, votes.tolist())).items())
    share, table = weak_quality.estimate(patterns, len(rates))
    assert abs(share - 0.8) < 0.02
    for j, (on_bad, on_good) in enumerate(rates):
        vote = -1 if j < 4 else 1
        assert abs(table[j][vote] - np.log(on_good / on_bad)) < 0.4 and abs(table[j][0] - np.log((1 - on_good) / (1 - on_bad))) < 0.1
    belief = {v: 1 / (1 + np.exp(-(np.log(share / (1 - share)) + sum(table[j][x] for j, x in enumerate(v))))) for v, _ in patterns}
    found = np.array([belief[tuple(v)] >= 0.5 for v in votes.tolist()])
    assert (found == good).mean() > 0.96
    assert weak_quality.estimate([], 2) == (weak_quality.PRIOR_GOOD, [{-1: 0.0, 0: 0.0, 1: 0.0}] * 2)


def test_html_in_a_table(spark):
    page = "<nav>m</nav><article><p>The text of it all.</p><p>Ends.</p></article>"
    pages = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 5), (None, "v", "", 5), (1, "u", page, 5)], "page_id long, url string, html string, n_chars int")
    due = [(None, "v", "", 0), (1, "u", "The text of it all. Ends.", 25), (1, "u", "The text of it all. Ends.", 25), (2, None, "", 0)]
    assert sorted(map(tuple, html_text.extract(pages).collect()), key=str) == sorted(due, key=str)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_time_is_linear():
    import time

    began = time.time()
    text = html_text.main_text("<div><article>" * 20_000 + "<p>word word word</p>" * 2_000)
    assert text.count("word") == 6_000 and time.time() - began < 10


def test_html():
    page = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href=x>Home</a></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1>
    <p>One <b>two</b>three.<br><p>Long  text&nbsp;here<div class="comments"><p>Reader says</p></div><p>End.</p></article><footer>&copy; f</footer>"""
    assert html_text.main_text(page) == "A & B One twothree. Long text here End."
    assert html_text.main_text(None) == "" == html_text.main_text("<nav>x</nav>")
    body = "<div>" + "<p>A sentence that is long enough to count as text, with words in it.</p>" * 3 + "</div>"
    assert html_text.main_text(f"<ul><li><a>Menu</a></li></ul>{body}<aside>x</aside>").count("sentence") == 3
    html_text.main_text("<!--" * 20_000 + '<a "' * 20_000)


def test_html_of_unmarked_pages():
    long = "<p>A sentence that is long enough to count as text, with words in it, and goes on for a while.</p>"
    links = "<p><a href=x>One</a></p>" * 3
    found = html_text.main_text(f"<body>{links}<h1>Title</h1><p>By me.</p><p>Today.</p>{long}{links}<p>The end.</p></body>")
    assert found.startswith("Title By me. Today. A sentence") and found.endswith("a while. The end.") and "One" not in found
    assert html_text.main_text(f"<div><p>Stray.</p></div>{links}<div>{long}</div>").startswith("A sentence")


def test_html_surge_on_marked_pages():
    long = "<p>" + "A long paragraph of the story that the page tells. " * 10 + "</p>"
    remark = '<article class="comment-body"><p>A reader says so.</p></article>'
    assert html_text.main_text(f"<div>{long}</div><p>Stray.</p>{remark}").endswith("tells.")
    assert "reader" not in html_text.main_text(f"<main><article>{long}</article>{remark}</main>") + html_text.main_text(f"<article>{long}</article><section>{remark}</section>")
    assert html_text.main_text(f"<p>Stray.</p><article>{long}</article>").startswith("A long paragraph")
    gap = "<p><button>a</button><button>b</button><button>c</button></p>"
    assert html_text.main_text(f"<article>{long}</article><article>{gap}<p>Hm.</p>{gap}</article>").endswith("tells.")
    assert html_text.main_text("<article><p>Hm.</p></article>") == "Hm."


def test_html_comments_of_readers():
    long = "<p>" + "A long paragraph of the story that the page tells. " * 10 + "</p>"
    said = "<p>" + "I have read it and say what I think of it here. " * 5 + "</p>"
    for remark in (f'<article class="comment">{said}</article>', f'<section id="comments"><article>{said}</article></section>', f'<div class="user-comments"><main>{said}</main></div>', f'<article id="reply-7">{said}</article>'):
        for page in (f"<article>{long}</article>{remark}", f"<main>{long}{remark}</main>", f"<body>{long}{remark}</body>", f"<article>{long}{remark}</article>"):
            assert html_text.main_text(page).endswith("page tells."), (remark, page[:20])
    for name in ("post comments-open", "no-comments", "comments-closed", "respond-off"):
        assert html_text.main_text(f'<article class="{name}">{long}</article>').endswith("page tells.")


def test_html_window_on_stripped_pages(spark):
    """Without any names and marks the text is nearly the same: no word is lost, and few come in."""
    lost = stray = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        bare = re.sub(r"<(/?)(article|main|nav|header|footer|aside|section)\b", r"<\1div", r.html, flags=re.I)
        bare = re.sub(r"\s(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", bare)
        a, b = (collections.Counter(html_text.main_text(p).split()) for p in (r.html, bare))
        lost, stray, total = lost + sum((a - b).values()), stray + sum((b - a).values()), total + sum(a.values())
    assert lost <= 0.001 * total and stray <= 0.01 * total


def test_html_names_of_wrappers():
    assert html_text.main_text('<div class="layout has-sidebar"><article><p>Text.</p><div class="share"><p>Tell all</p></div></article></div>') == "Text."
    assert html_text.main_text('<main><div class="has-sidebar"><article>Text.</article></div><div id="comments"><article class="comment">Me too</article></div></main>') == "Text."
    assert html_text.main_text("<aside><article>Teaser</article></aside>") == "" == html_text.main_text("<div hidden><article>Text</article></div>")


def test_url_rules(spark):
    urls = ["https://A.Example.org/es/1?q", "http://example.org/en/1x", "https://www.site.com/fr/2#t", "https://site.com/de/9", "https://x.net/es/3", "nothing", None, "ftp://", "http://org"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls * 3)], "page_id long, url string, rule string")
    found = {r.page_id: r for r in url_rules.judge(pages, queries.URL_RULES).collect()}
    assert len(found) == 27
    assert [found[k].rule for k in range(9)] == ["example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, None, None, None]
    assert [found[k].verdict for k in range(4)] == ["block", "block", "allow", "block"]
    assert (found[4].host, found[4].path, found[4].verdict, found[4].method_verdict) == ("x.net", "/es/3", "block", "block")
    assert (found[6].host, found[6].path, found[6].verdict) == ("", "", "allow")
    assert url_rules.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_url_tokens_are_whole(spark):
    url = "https://a.b.c.d.casino-win.com/1/two/three/four/five?X1=2&y"
    host, path = url_rules.host_and_path(F.lit(url))
    found = set(spark.range(1).select(url_rules.tokens(host, path, url_rules.query_of(F.lit(url)))).first()[0])
    assert found >= {"host:a.b.c.d.casino-win.com", "host:com", "word:a", "word:casino", "word:win", "path1:#", "path4:four", "path:four", "last:five", "query:x#", "query:y"}


@pytest.mark.parametrize("url", ["https://casino-win-{0}.com/1/2/3/4/5", "https://s{0}.org/1/2/3/marked/5", "https://s{0}.org/1/2/3/4/5?marked=1", "https://casino.c{0}.d{0}.e{0}.net/1/2/3/4/5"])
def test_url_rules_learn_from_every_part(spark, url):
    rules = [url_rules.Rule(url.format(k).split("/")[2], "", "block") for k in range(4)]
    rules += [url_rules.Rule(f"good{k}.com", "", "allow") for k in range(4)] + [url_rules.Rule(f"good{k}.org", "", "allow") for k in range(4)] + [url_rules.Rule("good.net", "", "allow")]
    urls = [url.format(k) for k in range(4)] * 5 + [f"https://good{k}.{t}/1/2/3/4/5" for k in range(4) for t in ("com", "org")] * 5 + ["https://good.net/1/2/3/4/5"] * 40
    new = url.format(9)
    pages = spark.createDataFrame([(k, u) for k, u in enumerate([*urls, new])], "page_id long, url string")
    assert url_rules.judge(pages, rules).where(F.col("page_id") == len(urls)).first().method_verdict == "block"


def test_url_size_decides_for_no_other(spark):
    """One labelled URL of many common segments takes no rule away, and rules on its own segments hold what they hold for all."""
    rules = [url_rules.Rule("org", "", "allow"), url_rules.Rule("com", "", "block")]
    plain = [f"http://a{k}.org/guide/x{k}?p=1" for k in range(60)] + [f"http://b{k}.com/win/x{k}?q=1" for k in range(60)] + [f"http://c{k}.net/{'guide' if k % 2 else 'win'}/y" for k in range(10)]
    long = ["http://long.com/" + "/".join([f"s{chr(97 + j)}" for j in range(30)] + ["win"])] * 8
    verdicts = lambda urls: {r.page_id: (r.method_verdict, r.confidence) for r in url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).where("page_id between 120 and 129").collect()}
    before, after = verdicts(plain), verdicts(plain + long)
    assert {k: v for k, (v, _) in before.items()} == {k: v for k, (v, _) in after.items()} == {120 + k: "allow" if k % 2 else "block" for k in range(10)}
    labelled = spark.createDataFrame([([f"t{j}" for j in range(k % 25 + 1)], "allow" if k % 3 else "block") for k in range(200)], "tokens array<string>, verdict string")
    rows = [(set(r.tokens), r.verdict) for r in labelled.collect()]
    mined = url_rules.mine(labelled, 0.05, 0.5)
    assert mined
    for m in mined:
        held = [v for t, v in rows if all(t & set(item) for item in m.items)]
        assert abs(m.confidence - np.mean([v == m.verdict for v in held])) < 1e-9 and abs(m.support - sum(v == m.verdict for v in held) / 200) < 1e-9


def test_classifiers(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for k in range(400):
        t = rng.choices(words, k=40)
        toxic, poor = k % 7 == 0, k % 5 == 0
        t[3:5] = ["idiot", "trash"] if toxic else t[3:5]
        rows.append((k, " ".join(w.upper() + "!!" for w in t) if poor else " ".join(t)))
        labels.append((k, int(not poor), int(toxic)))
    docs = documents(spark, [*rows, (500, None), (501, "")])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    poor = pu_quality.classify(docs, marks).where("held_out and doc_id < 400").collect()
    assert np.mean([r.predicted == (r.doc_id % 5 != 0) for r in poor]) > 0.95
    toxic = toxicity_chain.classify(docs, marks).where("held_out and doc_id < 400").collect()
    assert np.mean([r.predicted == (r.doc_id % 7 == 0) for r in toxic]) > 0.95
    assert toxicity_chain.classify(docs, marks.limit(0)).agg(F.sum("predicted")).first()[0] == 0
    assert pu_quality.classify(docs.limit(0), marks).count() == 0


@pytest.mark.parametrize(("sf", "good", "bad"), [("sf0.001", 0.9, 0.1), ("sf0.01", 0.9, 0.1)])
def test_classifiers_on_small_tables(spark, sf, good, bad):
    """Held-out labels: quality as in `good` and `bad`, and of clean documents 2 % at most toxic."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = pu_quality.classify(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted for r in held if r.quality == 1]) >= good and np.mean([r.predicted for r in held if r.quality == 0]) <= bad
    rows = toxicity_chain.classify(docs, labels).join(labels, "doc_id").collect()
    assert np.mean([r.predicted for r in rows if r.held_out and r.toxic == 0]) <= 0.02
    if sf == "sf0.01":
        assert np.mean([r.predicted for r in rows if r.toxic == 1]) >= 0.6


def test_toxicity_threshold_spares_the_clean():
    rng = np.random.default_rng(0)
    y = np.arange(400) < 40
    assert toxicity_chain.best_threshold(rng.uniform(size=400) * 0.2, y) == np.inf
    assert 0.1 < toxicity_chain.best_threshold(np.where(y, 0.3, 0.1) + rng.uniform(size=400) * 0.05, y) < 0.3
    assert toxicity_chain.best_threshold(np.zeros(0), np.zeros(0, bool)) == np.inf == toxicity_chain.best_threshold(np.ones(3), np.ones(3, bool))


def test_toxicity_in_every_language(spark):
    """Held-out recall and precision by language on the labelled documents of sf0.1."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity_chain.classify(docs.join(labels.select("doc_id"), "doc_id", "left_semi").repartition(8), labels)
    rows = found.where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").select("lang", "toxic", "predicted").collect()
    for lang in ("en", "de", "fr", "es"):
        toxic, clean = ([r.predicted for r in rows if r.lang == lang and r.toxic == k] for k in (1, 0))
        assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.02


def test_toxicity_with_given_categories(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    rows = [(k, " ".join([*rng.choices(words, k=30), *(["Zoundlet", "zoundling"] if k % 4 == 0 else []), *(["grabblish"] if k % 8 == 0 else [])])) for k in range(300)]
    marks = spark.createDataFrame([(k, int(k % 4 == 0), int(k % 8 == 0), "x") for k in range(300)], "doc_id long, toxic int, threat int, score string")
    docs = documents(spark, [*rows, (None, rows[0][1]), (400, None), (401, " "), (402, "zoundlike " + "x" * 300_000), (8, rows[8][1])])
    found = toxicity_chain.classify(docs, marks, categories=("threat",)).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == 305 and "p_threat" in found[0] and by_id[None].held_out is False
    assert all((r.predicted == 1) == (r.doc_id % 4 == 0) and (r.p_threat > 0.5) == (r.doc_id % 8 == 0) for r in found if r.doc_id is not None and r.doc_id < 300)
    assert by_id[400].predicted == by_id[401].predicted == 0 and len({(r.score, r.predicted) for r in found if r.doc_id == 8}) == 1
    assert toxicity_chain.classify(docs.limit(0), marks).count() == 0


def test_pipeline_stages_equal_brute_force(spark, corpus, tmp_path):
    """Each stage on a small table with near copies, personal data, nulls, blanks, repeated rows and columns of clashing names."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)
    rows = [(i, t, "en", "src", len(t) if t is not None else None, "mine") for i, t in corpus] + [(None, "no id, but words", "en", "src", 16, "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _q string").cache()
    spark.createDataFrame([(k, int(k % 9 > 0)) for k in range(5, 105)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    listed = lambda df: sorted(map(str, df.collect()))
    for name in ("quality_classifier", "quality_rules", "near_duplicates", "personal_data"):
        assert stage[name](spark, docs, str(tmp_path)).columns == docs.columns
        assert stage[name](spark, docs.limit(0), str(tmp_path)).count() == 0

    kept = {r.doc_id for r in weak_quality.judge(docs).where("kept").collect()}
    assert listed(stage["quality_rules"](spark, docs, "")) == listed(docs.where(F.col("doc_id").isin(list(kept - {None})) | (F.col("doc_id").isNull() & F.lit(None in kept))))

    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := WORD.findall((t or "").lower())) else set() for i, t in corpus}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    heads = components_of(links, sets)
    assert len({i for i, h in heads.items() if i != h}) > 20
    due = docs.where(F.col("doc_id").isNull() | F.col("doc_id").isin([i for i, h in heads.items() if i == h]))
    assert listed(stage["near_duplicates"](spark, docs, "")) == listed(due)

    def masked(text):
        out, at = "", 0
        for s, e, kind in pii.find(text)[1]:
            if s >= at:
                out, at = out + text[at:s] + f"<{kind.upper()}>", e
        return out + text[at:]

    found = {(r.doc_id, r.text, r.n_chars) for r in stage["personal_data"](spark, docs, "").collect()}
    assert found == {(r.doc_id, r.text and masked(r.text), r.text if r.text is None else len(masked(r.text))) for r in docs.collect()}

    packed = stage["best_fit_packing"](spark, docs, "").collect()
    pieces = sum(len(packing.cut(len(packing.encode(t or "")) + 1, 2048)) for _, t, *_ in rows)
    tokens = sum(len(packing.encode(t or "")) + 1 for _, t, *_ in rows)
    assert len(packed) == pieces and sum(r.length for r in packed) == tokens
    assert len({r.sequence_id for r in packed}) <= -(-tokens // 2048) + 1  # as few as can be, or one more


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    packed = corpus_pipeline.run(spark, sf)
    kept = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert 0.5 * len(rows) < len(kept) <= len(rows)
    assert len(kept) == len({hashlib.sha1((rows[k] or "").encode()).digest() for k in kept})


def test_url_rules_of_any_size(spark):
    """Rules of more items than FP-growth may propose are there, and all that are kept equal those of all sets by brute force."""
    from itertools import combinations

    rng = random.Random(3)
    rows = [([f"t{j}" for j in range(5) if bits >> j & 1] or ["none"], "block" if bits == 31 else "allow") for bits in range(32)] * 3
    rows += [(["a", "z"], "block") if k % 2 else ([rng.choice("az")], "allow") for k in range(40)]
    short = [(set(own), v) for own, v in rows]
    mined = {(frozenset(t for item in m.items for t in item), m.verdict) for m in url_rules.mine(spark.createDataFrame([(sorted(own), v) for own, v in short], "tokens array<string>, verdict string"), 0.02, 0.9)}
    due, names = [], sorted(set().union(*(own for own, _ in short)))
    for size in range(1, 7):
        for own in map(frozenset, combinations(names, size)):
            held = [v for o, v in short if own <= o]
            for v in ("allow", "block"):
                if held.count(v) >= 3 and held.count(v) >= 0.9 * len(held) and not any(k <= own and w == v and c >= held.count(v) / len(held) for k, w, c in due):
                    due.append((own, v, held.count(v) / len(held)))
    assert mined == {(own, v) for own, v, _ in due} and (frozenset(["t0", "t1", "t2", "t3", "t4"]), "block") in mined
