"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pennyworks.llm import bpe_transducer, embedding_dedup, embedding_whitening, html_text, ngram_jaccard, packing, pii, prefix_trie, pu_quality
from pennyworks.llm import sentencepiece_scan, toxicity_chain, url_rules, weak_quality
from pennyworks.llm.common import table

URL_RULES = [
    url_rules.Rule("org", "", "allow"),
    url_rules.Rule("example.org", "es/", "block"),
    url_rules.Rule("example.org", "en/1", "block"),
    url_rules.Rule("com", "fr/", "allow"),
    url_rules.Rule("com", "de/", "block"),
]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and its place there; a null text is empty."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL, by the given rules or by mined ones; a URL that is null or without a host has empty parts."""
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of every document's ids, and whether they decode to its text."""
    decoded = sentencepiece_scan.decode(sentencepiece_scan.encode(table(spark, sf_dir, "documents")))
    text = F.coalesce("text", F.lit(""))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", (F.col("decoded") == text).alias("round_trip"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector; those that cannot be compared link with nothing."""
    return embedding_dedup.cluster(table(spark, sf_dir, "embeddings"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of shingles and component of every document; texts without words link with nothing."""
    return ngram_jaccard.cluster(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every document's personal data; a null text has none."""
    found = pii.spans(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    n = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    added = (F.size("all") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *n, F.sha2(pii.digest("base"), 256).alias("base_sha256"), pii.digest("all").alias("spans"), added)


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, empty ones too."""
    return pu_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_weak_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and whether it is kept; a null text has no words and is not."""
    return weak_quality.judge(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; a null page has an empty one."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, empty ones too."""
    return toxicity_chain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of another."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), rebuilt=True)


def op12_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids, and the digest of what they decode to."""
    done = bpe_transducer.encode(table(spark, sf_dir, "documents"), back=True)
    raw = F.sha2(F.col("decoded").cast("binary"), 256)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), raw.alias("decoded_sha256"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every vector; a deviation beyond a long is null."""
    found = embedding_whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_url_rules, op3_sentencepiece_scan, op4_embedding_dedup, op5_ngram_jaccard,
        op6_pii, op7_pu_quality, op8_weak_quality_rules, op9_html_text, op10_toxicity_chain,
        op11_prefix_trie, op12_bpe_transducer, op13_embedding_whitening,
    )
}

#: crc32 bit by bit: a byte of the text is met by xor, then eight shifts follow it.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""

ORACLES: dict[str, str] = {
    "op11_prefix_trie": f"""
WITH own AS (SELECT conv_id, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, COALESCE(role, '') AS role, COALESCE(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM own),
cut AS (SELECT conv_id, {_CRC} % 6 AS h FROM ids),
built AS (SELECT i.conv_id, b.pos, b.role, b.text FROM cut i JOIN own b ON b.conv_id = i.conv_id - i.conv_id % 100 AND b.pos < i.h
    UNION ALL SELECT o.conv_id, o.pos, o.role, o.text FROM own o JOIN cut i ON o.conv_id = i.conv_id WHERE o.pos >= i.h),
turn AS (SELECT conv_id, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY pos) AS d, LENGTH(text) AS n, LENGTH(role) || ':' || LENGTH(text) || ':' || role || text AS k FROM built),
path AS (SELECT conv_id, d, n, STRING_AGG(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS key FROM turn UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
node AS (SELECT key, MIN(d) AS d, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, (COUNT(*) - 1) * MIN(n) AS saved FROM path GROUP BY 1),
up AS (SELECT n.key, p.key AS above FROM node n JOIN path p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
kids AS (SELECT above AS key, COUNT(*) AS n_children FROM up GROUP BY 1),
below AS (SELECT p.key, SUM(m.saved) AS saved_tokens, COUNT(*) FILTER (WHERE k.key IS NULL) AS n_leaves
    FROM node m LEFT JOIN kids k ON k.key = m.key JOIN path p ON p.conv_id = m.conv_id AND p.d <= m.d GROUP BY 1),
stop AS (SELECT key, SHA256(STRING_AGG(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS s FROM (SELECT conv_id, ARG_MAX(key, d) AS key FROM path GROUP BY 1) GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, a.conv_id AS parent_conv_id, n.n_convs, COALESCE(k.n_children, 0) AS n_children, b.n_leaves,
    CAST(b.saved_tokens AS BIGINT) AS saved_tokens, COALESCE(s.s, SHA256('')) AS ends_sha256
FROM node n LEFT JOIN kids k ON k.key = n.key JOIN below b ON b.key = n.key LEFT JOIN stop s ON s.key = n.key LEFT JOIN up u ON u.key = n.key LEFT JOIN node a ON a.key = u.above""",
}
