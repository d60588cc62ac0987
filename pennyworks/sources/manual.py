"""Ledgers written by hand, whose transactions get ids from their content, and the list of ids to leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pennyworks.sources.scratch import written

#: So many beginnings of ids, with their lengths, are looked up in the plan; and so many ids are broadcast.
HEADS, IDS = 500, 1_000_000


def with_ids(txns: DataFrame) -> DataFrame:
    """Transactions(date, payee, narration, meta, postings) that all have a `txn:` in their meta.

    Where there is none, it is `manual-`, a hash of what the transaction says, and from the second of equal ones on their number, so that the ids do
    not depend on the order that files are read in. Equal transactions without an id are numbered together.
    """
    legs = F.array_join(F.transform("postings", lambda p: F.concat_ws(" ", p["account"], p["amount"].cast("string"), p["commodity"])), ";")
    said = F.concat_ws("\n", "date", F.coalesce("payee", F.lit("")), F.coalesce("narration", F.lit("")), F.coalesce("meta", F.lit("")), legs)
    bare = ~F.coalesce("meta", F.lit("")).rlike(r"(?:^|[\s,])txn:")
    rows = txns.withColumn("_id", F.substring(F.sha2(said, 256), 1, 12)).withColumn("_bare", bare)
    nth = F.row_number().over(Window.partitionBy("_id").orderBy("_id"))
    named, unnamed = rows.where("not _bare"), rows.where("_bare").withColumn("_k", nth)
    ident = F.concat(F.lit("txn:manual-"), "_id", F.when(F.col("_k") > 1, F.concat(F.lit("-"), F.col("_k").cast("string"))).otherwise(""))
    unnamed = unnamed.withColumn("meta", F.concat_ws(", ", ident, F.nullif("meta", F.lit("")))).drop("_k")
    return named.unionByName(unnamed).select(*txns.columns)


def without_ignored(txns: DataFrame, ignored: DataFrame) -> DataFrame:
    """Transactions whose meta contains none of ignored(id), at any place.

    Stretches of a meta that begin as some id does and are as long as an id of that beginning meet the ids by equality, so the list may be long. The driver
    sees how many characters ids have, by their first two characters where these pairs are few. A null meta contains nothing, and an empty id is none.
    """
    ids = written(ignored.where("id <> ''").select("id").distinct(), "ids")
    size, head = F.length("id").alias("n"), F.substring("id", 1, 2).alias("head")
    starts = ids.select(head, size).distinct().limit(HEADS + 1).collect()
    if len(starts) > HEADS:
        starts = [(None, r.n) for r in ids.select(size).distinct().collect()]
    by_head: dict[str | None, list[int]] = {}
    for h, n in starts:
        by_head.setdefault(h, []).append(n)
    if not by_head:
        return txns
    metas, lengths = txns.select("meta").where("meta is not null"), F.array(*map(F.lit, by_head.get(None, [])))
    at = metas.select("meta", F.explode(F.sequence(F.lit(1), F.greatest(F.length("meta"), F.lit(1)))).alias("at"))
    if None not in by_head:
        known = F.create_map(*(x for h, ns in by_head.items() for x in (F.lit(h), F.array(*map(F.lit, sorted(ns))))))
        one = F.try_element_at(known, F.substr("meta", "at", F.lit(1)))  # an id of one character
        lengths = F.concat(*(F.coalesce(x, F.array().cast("array<int>")) for x in (F.try_element_at(known, F.substr("meta", "at", F.lit(2))), one)))
    stretch = at.select("meta", "at", F.explode(lengths).alias("n")).select("meta", F.substr("meta", "at", "n").alias("id"))
    few = ids.count() <= IDS
    hit = stretch.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("meta").distinct()
    return txns.join(hit, "meta", "left_anti").select(*txns.columns)
