"""Quality rules as weak supervision, with DataFrame functions only.

Each rule looks at counts of a text and votes good, bad or abstains, or does not apply to so short a text. The votes of all
documents are counted by pattern (at most 4 to the number of rules patterns, whatever the number of documents);
expectation-maximisation over those patterns estimates how often each rule casts each vote on good and on bad documents, and
each document's posterior probability of being good follows from its votes. The base rules stay hard limits.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pennyworks.llm.common import ASCII_SPACES, SPACE_CLASS, materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 5
KEEP_FROM = 0.5
PRIOR_GOOD = 0.85


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, however often body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the text."""
    windows = lambda w: F.transform(
        w, lambda _, i: F.when(i + WINDOW <= F.size(w), F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    )
    keyed = lambda w: F.filter(
        F.transform(windows(w), lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: x["h"].isNotNull()
    )
    again = lambda s: F.sort_array(
        F.filter(
            F.transform(
                s,
                lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"]),
            ),
            lambda i: i.isNotNull(),
        )
    )
    covered = lambda p: F.aggregate(
        F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return F.when(F.size(words) > WINDOW, _let(words, lambda w: _let(F.sort_array(keyed(w)), lambda s: _let(again(s), covered)))).otherwise(0)


def _words(text: Column) -> Column:
    """Words between ASCII white space; the pattern is possessive, so long runs are taken in one step."""
    return F.filter(F.split(text, SPACE_CLASS + "++"), lambda w: w != "")


def _fresh(names: list[str], wanted: str) -> str:
    """wanted, with underscores in front until no column (of any case) has that name."""
    while wanted.lower() in {n.lower() for n in names}:
        wanted = "_" + wanted
    return wanted


def counts(docs: DataFrame, keep: list[str], into: str = "_q") -> DataFrame:
    """The columns `keep` of docs and a struct `into` of counts per row; a null text has no words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t_name, w_name = _fresh(keep, "_t"), _fresh(keep, "_w")
    staged = docs.select(*keep, text.alias(t_name), _words(text).alias(w_name))
    t, w = F.col(t_name), F.col(w_name)
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, ASCII_SPACES, "")) > 0)
    chars = F.length(t)
    without = lambda s: chars - F.length(F.translate(t, s, ""))
    distinct = _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    q = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, ASCII_SPACES, "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        distinct.alias("lines"),
        _repeated_words(w).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        without("!").cast("long").alias("n_bangs"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        without("0123456789").cast("long").alias("n_digits"),
        without("|").cast("long").alias("n_bars"),
    )
    return staged.select(*keep, q.alias(into))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])


def votes(q: Column) -> dict[str, Column]:
    """Votes by rule: 1 good, -1 bad, 0 abstains, null if it does not apply. A rule that knows a defect abstains where it sees none."""
    words, chars = F.greatest(q["n_words"], F.lit(1)), F.greatest(q["word_chars"], F.lit(1))
    bad = lambda value, limit: F.when(value >= limit, -1).otherwise(0)
    return {
        "symbols": bad(q["n_symbols"] / words, 0.25),
        "bars": bad(q["n_bars"] / words, 0.15),
        "bangs": bad(q["n_bangs"] / words, 0.4),
        "upper": bad(q["n_upper"] / chars, 0.4),
        "repeats": bad(q["n_repeat_words"] / words, 0.2),
        "lines": bad((q["lines"]["n"] - q["lines"]["d"]) / F.greatest(q["lines"]["n"], F.lit(1)), 0.5),
        "digits": bad(q["n_digits"] / chars, 0.4),
        "word_length": F.when((chars / words < 2.2) | (chars / words > 16), -1).otherwise(0),
        "variety": F.when(words < 30, None).when(q["n_distinct"] / words < 0.08, -1).when(q["n_distinct"] / words > 0.35, 1).otherwise(0),
        "prose": F.when(words < 20, None).when((q["n_symbols"] + q["n_bangs"] <= 0.02 * words) & (q["n_upper"] <= 0.2 * chars), 1).otherwise(0),
    }


#: What is believed of a vote before any text is seen: it is right so often, which counts as so many documents.
PRIOR_RIGHT, PRIOR_DOCUMENTS = 0.9, 10.0
VOTES = (-1, 0, 1)
Pattern = tuple[int | None, ...]


def estimate(patterns: list[tuple[Pattern, int]], n_rules: int, rounds: int = 200) -> tuple[float, list[dict[int, float]]]:
    """Share of good documents and, by rule and vote, the log odds that the vote adds for good; a rule that does not apply adds none.

    Each round estimates from every pattern's posterior how often a rule casts each vote on good and on bad documents to
    which it applies, and from these the posteriors. It starts from the belief that whoever votes bad is right.
    """
    cast = np.array([[[x == k for k in VOTES] for x in v] for v, _ in patterns], dtype=float).reshape(len(patterns), n_rules, 3)
    count = np.array([c for _, c in patterns], dtype=float)
    if not count.sum():
        return PRIOR_GOOD, [dict.fromkeys(VOTES, 0.0) for _ in range(n_rules)]
    seen = np.einsum("p,pjk->jk", count, cast)
    seen = (seen + 1e-9) / (seen + 1e-9).sum(axis=1, keepdims=True)
    prior_good = PRIOR_DOCUMENTS * seen * 2 * np.array([1 - PRIOR_RIGHT, 0.5, PRIOR_RIGHT]) + 0.5
    prior_bad = PRIOR_DOCUMENTS * seen * 2 * np.array([PRIOR_RIGHT, 0.5, 1 - PRIOR_RIGHT]) + 0.5
    belief = np.where(cast[:, :, 0].any(axis=1), 0.02, 0.98)
    for _ in range(rounds):
        share = float(np.clip((count @ belief + 10 * PRIOR_GOOD) / (count.sum() + 10), 1e-4, 1 - 1e-4))
        good = np.einsum("p,pjk->jk", count * belief, cast) + prior_good
        bad = np.einsum("p,pjk->jk", count * (1 - belief), cast) + prior_bad
        odds = np.log(good / good.sum(axis=1, keepdims=True)) - np.log(bad / bad.sum(axis=1, keepdims=True))
        z = math.log(share / (1 - share)) + np.einsum("pjk,jk->p", cast, odds)
        before, belief = belief, 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        if np.abs(belief - before).max() < 1e-9:
            break
    return share, [dict(zip(VOTES, map(float, row), strict=True)) for row in odds]


def posterior(rules: dict[str, Column], share: float, table: list[dict[int, float]]) -> Column:
    z = F.lit(math.log(share / (1 - share)))
    for vote, row in zip(rules.values(), table, strict=True):
        z = z + F.when(vote == -1, row[-1]).when(vote == 0, row[0]).when(vote == 1, row[1]).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def _learn(counted: DataFrame, counts_in: str = "_q") -> tuple[float, list[dict[int, float]]]:
    rules = votes(F.col(counts_in))
    voted = counted.select(*[v.cast("int").alias(k) for k, v in rules.items()])
    rows = voted.groupBy(*rules).count().orderBy(*rules).collect()  # at most 4 ** len(rules) patterns
    return estimate([(tuple(r[:-1]), r[-1]) for r in rows], len(rules))


def judge(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the base counts, base_failed, posterior and kept for every row of docs.

    A null text counts as empty, and such a row fails the base rules. Repeated rows are judged alike,
    nulls in doc_id pass through, an empty table gives an empty result, other columns are not read. A text is counted
    whole, however long; of two equal votes neither wins, the posterior then is the share of good documents.
    """
    counted = materialize(counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]), "quality-counts")
    share, table = _learn(counted)
    q = F.col("_q")
    failed = base_failed(q)
    good = posterior(votes(q), share, table)
    return counted.select(
        "doc_id",
        *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols")],
        (q["lines"]["n"] - q["lines"]["d"]).cast("long").alias("n_dup_lines"),
        q["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (good >= keep_from)).alias("kept"),
        good.alias("posterior"),
    )


def keep_good(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of docs that are kept, with their own columns, whatever these are called.

    A null or empty text fails the base rules and goes; repeated rows are judged alike; texts are judged whole; an empty
    table gives an empty result. The rows are written once with their counts, which are learnt from and then filtered by.
    """
    names = docs.columns
    into = _fresh(names, "_q")
    counted = materialize(counts(docs, names, into), "quality-rows")
    share, table = _learn(counted, into)
    q = F.col(into)
    return counted.where(~base_failed(q) & (posterior(votes(q), share, table) >= keep_from)).select(*names)
