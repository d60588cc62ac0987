"""URL filtering by given rules and by association rules mined from labelled URLs, with DataFrame functions only.

Each URL is a set of tokens. Tokens that occur in the very same labelled URLs are one item, for which any of them may stand:
rules on either have the same support and confidence. FP-growth mines the items' combinations that go with a verdict; rules are
pruned by support, by confidence, and where a shorter rule is as sure. An inverted index from each rule's rarest item to the
rule finds what fits a URL without looking at other rules.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pennyworks.llm.common import ascii_lower
from pennyworks.sources.scratch import written

MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
#: FP-growth lists all subsets of a basket, so the items of a labelled URL that has more go in as several baskets, and what comes out is counted again.
BASKET = 12
#: Items of a rule that FP-growth may propose; longer ones come from _whole().
MOST_ITEMS = 4
ALLOW, BLOCK = "allow", "block"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


class Mined(NamedTuple):
    """Each item is the tokens that may stand for it."""

    items: tuple[tuple[str, ...], ...]
    verdict: str
    confidence: float
    support: float


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the URL is null or has no `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def matched(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(length, rule, verdict), or null. `rules` is a short list."""
    if not rules:
        return F.lit(None).cast("struct<length: int, rule: string, verdict: string>")
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith("/" + r.path),
            F.struct(F.lit(len(r.host) + len(r.path)).alias("length"), F.lit(f"{r.host}/{r.path}").alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fits))


def query_of(url: Column) -> Column:
    """What stands between `?` and `#`; empty if there is none, the URL is null or has no `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^?#]*+\?([^#]*+)", 1), F.lit(""))


def _parts(text: Column, by: str) -> Column:
    return F.filter(F.split(text, by), lambda x: x != "")


def tokens(host: Column, path: Column, query: Column) -> Column:
    """All host suffixes, words of host labels, path segments (by place, and anywhere) and query keys; digits count as one token."""
    labels = _parts(host, r"\.")
    size = F.size(labels)
    suffixes = F.transform(labels, lambda x, i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i + 1, size), ".")))
    words = F.transform(_parts(host, r"[.-]"), lambda x: F.concat(F.lit("word:"), x))
    segments = F.transform(_parts(ascii_lower(path), "/"), lambda x: F.regexp_replace(x, "[0-9]++", "#"))
    placed = F.transform(segments, lambda x, i: F.concat(F.lit("path"), (i + 1).cast("string"), F.lit(":"), x))
    anywhere = F.transform(segments, lambda x: F.concat(F.lit("path:"), x))
    last = F.when(F.size(segments) > 0, F.array(F.concat(F.lit("last:"), F.get(segments, F.size(segments) - 1)))).otherwise(F.array().cast("array<string>"))
    keys = F.transform(_parts(ascii_lower(query), "[&;]"), lambda x: F.concat(F.lit("query:"), F.regexp_replace(F.regexp_extract(x, "^[^=]*+", 0), "[0-9]++", "#")))
    return F.array_distinct(F.concat(suffixes, words, placed, anywhere, last, keys))


def _items(known: DataFrame, least: int) -> list[tuple[int, tuple[str, ...]]]:
    """(URLs, tokens) of each item that is in `least` labelled URLs; support bounds them to a URL's tokens / MIN_SUPPORT."""
    mark = [F.pmod(F.xxhash64("tokens", F.lit(k)), F.lit(1 << 31)).alias(f"h{k}") for k in range(2)]  # sums tell sets of URLs apart
    each = known.select(F.explode("tokens").alias("t"), *mark)
    counted = each.groupBy("t").agg(F.count("*").alias("n"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1")).where(F.col("n") >= least)
    same = counted.groupBy("n", "h0", "h1").agg(F.sort_array(F.collect_list("t")).alias("tokens"))
    return [(r.n, tuple(r.tokens)) for r in same.collect()]


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[Mined]:
    """Rules from labelled(tokens, verdict).

    Every item of every labelled URL takes part, and figures of rules are over all labelled URLs, whatever the size of any of them: a URL of more
    than BASKET items is several baskets, which neighbouring tokens share, and rules are then counted again on whole URLs. What this leaves out is found by _whole().
    """
    known = labelled.where("verdict is not null")
    total = known.count()
    least = max(1, math.ceil(min_support * total))
    items = _items(known, least)
    if not items:
        return []
    first_of = {tokens[0]: tokens for _, tokens in items}
    own = F.array_intersect("tokens", F.from_json(F.lit(json.dumps(list(first_of))), "array<string>"))
    sets = known.select(own.alias("own"), F.concat(F.lit("verdict "), "verdict").alias("v"))
    at = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("own") / BASKET).cast("int") - 1, F.lit(0)))
    baskets = sets.select("v", F.explode(F.transform(at, lambda k: F.slice("own", k * BASKET + 1, BASKET))).alias("own"))
    split = sets.agg(F.max(F.size("own"))).first()[0] > BASKET
    # Of a split URL a verdict counts more than once, so confidence is only held against whole URLs.
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / (baskets.count() if split else total), minConfidence=0.0 if split else min_confidence)
    model = model.fit(baskets.select(F.concat("own", F.array("v")).alias("items")))
    verdict = F.get("consequent", F.lit(0))
    is_verdict = lambda x: x.startswith("verdict ")  # noqa: E731  tokens have no blank before their kind's colon
    rules = model.associationRules.where(is_verdict(verdict) & ~F.exists("antecedent", is_verdict)).where(F.size("antecedent") <= MOST_ITEMS)
    rules = rules.select("antecedent", F.substring(verdict, 9, 100).alias("verdict"), "confidence", "support")
    if split:
        rules = _recounted(rules.select("antecedent", "verdict"), sets, total).where((F.col("support") * total >= least - 0.5) & (F.col("confidence") >= min_confidence))
    found = [(tuple(r.antecedent), r.verdict, r.confidence, r.support) for r in rules.collect()] + _whole(sets, total, least, min_confidence)
    return prune([Mined(tuple(sorted(first_of[t] for t in own)), v, confidence, support) for own, v, confidence, support in found])


def _whole(sets: DataFrame, total: int, least: int, min_confidence: float) -> list[tuple]:
    """(items, verdict, confidence, support) of the rules over sets(own, v) that prune() can keep, of any number of items and from whole URLs: what baskets and MOST_ITEMS leave out.

    Level by level, from sets that may have a better longer one: often enough with a verdict, not sure of one, and in fewer URLs than each set of one item less. Of
    any other set the longer ones are no surer than a rule of fewer items, so nothing is lost. Like URLs are one row.
    """
    urls = written(sets.groupBy("own", "v").agg(F.count("*").alias("w")).withColumn("own", F.array_sort("own")), "url-sets")
    now, before, rules, size = urls.select("own", "v", "w", F.explode(F.transform("own", lambda t: F.array(t))).alias("set")), None, [], 1
    while True:
        hits = now.groupBy("set", "v").agg(F.sum("w").alias("hits"))
        counted = hits.groupBy("set").agg(F.sum("hits").alias("n"), F.max("hits").alias("most"), F.collect_list(F.struct("v", "hits")).alias("by")).where(F.col("most") >= least)
        if before is not None:
            parts = counted.select("set", "n", F.explode("set").alias("t")).withColumn("part", F.array_except("set", F.array("t")))
            fewer = parts.join(before.select(F.col("set").alias("part"), F.col("n").alias("m")), "part").where("n < m").groupBy("set").agg(F.count("*").alias("k"))
            counted = counted.join(fewer.where(F.col("k") == size).select("set"), "set", "left_semi")
        counted = written(counted, f"sets-{size}")
        sure = counted.select("set", "n", F.explode("by").alias("b")).where((F.col("b.hits") >= least) & (F.col("b.hits") / F.col("n") >= min_confidence))
        rules += [(tuple(r.set), r.v, r.hits / r.n, r.hits / total) for r in sure.select("set", F.substring("b.v", 9, 100).alias("v"), "b.hits", "n").collect()]
        before = counted.where("most < n").select("set", "n")
        if before.isEmpty():
            return rules
        last = F.element_at("set", -1)
        longer = F.transform(F.filter("own", lambda t: t > last), lambda t: F.concat("set", F.array(t)))
        now, size = now.join(before.select("set"), "set", "left_semi").select("own", "v", "w", F.explode(longer).alias("set")), size + 1
        now = written(now, "url-sets")


def _recounted(rules: DataFrame, sets: DataFrame, total: int) -> DataFrame:
    """rules(antecedent, verdict) with confidence and support over sets(own, v): each meets the URLs that hold its last item, and of these those that hold all."""
    due = rules.distinct().withColumn("t", F.element_at("antecedent", -1))
    met = sets.select("own", "v", F.explode("own").alias("t")).join(F.broadcast(due), "t").where(F.size(F.array_except("antecedent", "own")) == 0)
    hit = F.sum((F.col("v") == F.concat(F.lit("verdict "), "verdict")).cast("long"))
    found = met.groupBy("antecedent", "verdict").agg(hit.alias("hits"), F.count("*").alias("n"))
    return found.select("antecedent", "verdict", (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / total).alias("support"))


def prune(rules: list[Mined]) -> list[Mined]:
    """Without each rule that has a kept shorter one inside it with the same verdict and no less confidence."""
    kept: dict[frozenset, list[Mined]] = {}
    by_item: dict[tuple[str, ...], list[Mined]] = {}
    for r in sorted(rules, key=lambda r: (len(r.items), -r.confidence, r.items)):
        own = set(r.items)
        near = (k for t in r.items for k in by_item.get(t, ()))
        if any(k.verdict == r.verdict and k.confidence >= r.confidence and own.issuperset(k.items) for k in near):
            continue
        kept.setdefault(frozenset(own), []).append(r)
        by_item.setdefault(r.items[0], []).append(r)
    return [r for same in kept.values() for r in same]


def mined_verdict(found: Column, rules: list[Mined]) -> Column:
    """struct(confidence, size, verdict) of the surest rule whose items are all among the tokens `found`, or null."""
    kind = "struct<confidence: double, size: int, verdict: string, items: array<array<string>>>"
    if not rules:
        return F.lit(None).cast(kind)
    often = Counter(t for r in rules for t in r.items)
    index: dict[str, list[dict]] = {}
    for r in rules:
        rarest = min(r.items, key=lambda t: (often[t], t))
        for token in rarest:
            index.setdefault(token, []).append({"confidence": r.confidence, "size": len(r.items), "verdict": r.verdict, "items": [list(t) for t in r.items]})
    lookup = F.from_json(F.lit(json.dumps(index)), f"map<string, array<{kind}>>")
    postings = F.flatten(F.transform(F.array_intersect(found, F.map_keys(lookup)), lambda t: lookup[t]))
    return F.array_max(F.filter(postings, lambda r: F.forall(r["items"], lambda t: F.arrays_overlap(t, found))))


def judge(pages: DataFrame, rules: list[Rule], default: str = ALLOW, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, method_verdict and confidence for every row of pages(page_id, url).

    The given rules come first, and their verdicts on the URLs that they fit are the labels from which the rules for the others are mined. A null URL
    and one without `://` have an empty host and path, fit no rule and get the default. Nulls in page_id
    pass through, repeated rows come back as often as they came, an empty table gives an empty result, and
    other columns are not looked at. Of equally sure mined rules the one of more items wins, then the verdict later in the
    alphabet. URLs are read whole, however long.
    """
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), query_of(url).alias("query"))
    parts = parts.withColumn("m", matched(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("host"), F.col("path"), F.col("query")))
    mined = mine(parts.select("tokens", F.col("m.verdict").alias("verdict")), min_support, min_confidence)
    judged = parts.withColumn("r", mined_verdict(F.col("tokens"), mined))
    method = F.coalesce(F.col("r.verdict"), F.lit(default))
    return judged.select(
        "page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce(F.col("m.verdict"), method).alias("verdict"),
        method.alias("method_verdict"), F.col("r.confidence").alias("confidence"),
    )
