"""The trie of conversations by their turns, with totals of each subtree.

A turn stands for its content by a hash, verified against the texts. Numpy scans give every prefix of a conversation a polynomial rolling
fingerprint; equal fingerprints of a depth are a candidate node, which is verified turn by turn: all members must have the last turn and the
parent of the representative, the least conv_id. Those that have not are split off and carry a mark from there on.

The representatives cut the trie into chains: from some depth on, all that is left of a path has one representative. So subtree totals need no round
a depth: what a chain holds is summed, and each representative's own path rolls it up to all nodes above in one aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pennyworks.llm.common import discard, materialize
from pennyworks.llm.scans import prefix_scan

#: Any odd number with bits well mixed.
BASE = 0x9E3779B97F4A7C15
#: Ids in one block of text on the way to a digest.
BLOCK_IDS = 4096
INHERITED = 6
NODE = ["d", "f", "split", "split_at"]
PARENT = ["d - 1 AS d", "p AS f", "p_split AS split", "p_split_at AS split_at"]


def turns(conversations: DataFrame, hash_bits: int = 64) -> DataFrame:
    """(conv_id, turn, content, copy, n): each turn with the hash of its role and text, which of several contents with that hash it is, and its length."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    mixed = F.xxhash64("role", "text")
    rows = rows.withColumn("content", mixed if hash_bits == 64 else F.shiftrightunsigned(mixed, 64 - hash_bits)).withColumn("n", F.length("text").cast("long"))
    distinct = rows.select("content", "role", "text").distinct()
    shared = distinct.groupBy("content").count().where("count > 1").select("content")
    if not shared.take(1):
        return rows.select("conv_id", "turn", "content", F.lit(0).cast("long").alias("copy"), "n")
    # A hash of several contents: these are told apart by their number among them.
    from pyspark.sql import Window

    number = (F.row_number().over(Window.partitionBy("content").orderBy("role", "text")) - 1).cast("long").alias("copy")
    copies = distinct.join(shared, "content", "left_semi").select("content", "role", "text", number)
    found = rows.join(copies, ["content", "role", "text"], "left")
    return found.select("conv_id", "turn", "content", F.coalesce("copy", F.lit(0).cast("long")).alias("copy"), "n")


def inherit(numbered: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first turns of conversation c - c % 100, up to crc32(c) % 6 of them: their turns, with `pos` in order, and their lengths."""
    first = F.crc32(F.col("conv_id").cast("string").cast("binary")) % INHERITED
    own = F.col("conv_id") - F.col("conv_id") % 100
    heads = numbered.where(f"conv_id % 100 = 0 and pos < {INHERITED - 1}").groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("pos", "content", "copy", "n"))).alias("head"))  # 5 at most
    taken = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("first").cast("int"))
    plan = lengths.select("conv_id", "length", first.alias("first"), own.alias("base")).join(heads, "base", "left").select("conv_id", "length", "first", taken.alias("head"))
    copied = plan.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.content", "t.copy", "t.n")
    kept = numbered.where(F.col("pos") >= first).select("conv_id", "pos", "content", "copy", "n")
    length = F.size("head") + F.greatest(F.col("length") - F.col("first"), F.lit(0).cast("long"))
    return copied.unionByName(kept), plan.select("conv_id", length.alias("length"))


def _candidates(rows: DataFrame) -> DataFrame:
    """Nodes by fingerprint, each with what all its members should agree in, as the least and the largest."""
    same = [f(c).alias(f"{k}_{c}") for c in ("p", "p_split", "p_split_at", "content", "copy") for k, f in (("low", F.min), ("high", F.max))]
    return rows.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("n").alias("n"), *same)


def _verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes) where every node is one sequence of turns. Each pass mends the least depth where one is not; usually there is none."""
    agree = ["p", "p_split", "p_split_at", "content", "copy"]
    while True:
        nodes = materialize(_candidates(rows), "trie-nodes")
        off = " or ".join(f"low_{c} <> high_{c}" for c in agree)
        at = nodes.where(off).agg(F.min("d").alias("d")).first().d
        if at is None:
            return rows, nodes.select(*NODE, "n_convs", "conv_id", "n", *(F.col(f"low_{c}").alias(c) for c in agree[:3]))
        wrong = nodes.where(off).where(F.col("d") == at).select(*NODE, F.col("conv_id").alias("head"))
        members = rows.where(F.col("d") == at).join(wrong, NODE, "left_semi")
        groups = members.groupBy(*NODE, *agree).agg(F.min("conv_id").alias("own")).join(wrong, NODE).where("own <> head").select(*NODE, *agree, "own")
        moved = members.join(groups, [*NODE, *agree]).select("conv_id", "own")
        was, rows = rows, rows.join(moved, "conv_id", "left")
        new = lambda c, v, from_: F.when(F.col("own").isNotNull() & (F.col("d") >= from_), v).otherwise(F.col(c)).alias(c)
        mark = {"split": new("split", F.col("own"), at), "split_at": new("split_at", F.lit(at), at), "p_split": new("p_split", F.col("own"), at + 1), "p_split_at": new("p_split_at", F.lit(at), at + 1)}
        rows = materialize(rows.select(*(mark.get(c, c) for c in was.columns)), "trie-rows")
        discard(was, nodes)


def _digests(ends: DataFrame) -> DataFrame:
    """NODE and ends_sha256 of ends(NODE, conv_id): ids sorted over ranges, joined to blocks of text, and a node's blocks hashed in their order.

    A task holds a block, whatever the number of ids; of a node with very many, one task reads the blocks.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        out: list[tuple] = []

        def block() -> None:
            out.append((*node, ids[0], ",".join(map(str, ids))))
            ids.clear()

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64()] * 5 + [pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[*NODE, "first", "ids"])
            out.clear()
            return made

        for batch in batches:
            for *now, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if ids and (now != node or len(ids) >= BLOCK_IDS):
                    block()
                node = now
                ids.append(c)
            if out:
                yield batch_of()
        if ids:
            block()
            yield batch_of()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64()] * 4 + [pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[*NODE, "sha"])
            out.clear()
            return made

        for batch in batches:
            for *now, _, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now != node:
                    if sha:
                        out.append((*node, sha.hexdigest()))
                    node, sha = now, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield batch_of()
        if sha:
            out.append((*node, sha.hexdigest()))
            yield batch_of()

    key = ", ".join(f"{c} long" for c in NODE)
    ranged = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    blocks = ranged.mapInArrow(join, f"{key}, first long, ids string")
    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, f"{key}, sha string")


def trie(conversations: DataFrame, rebuilt: bool = False, hash_bits: int = 64, base: int = BASE) -> DataFrame:
    """The nodes of the trie of conversations(conv_id, turn, role, text), the textless root among them; all columns but the last are long.

    conv_id is the least member and depth the number of turns; with parent_conv_id, n_convs (members), n_children, n_leaves and saved_tokens of the
    subtree, and ends_sha256, the hash of the ids of members that end there. Turns are in order of `turn`, null first, equal ones in that of a hash of
    their content, repeated rows are turns of their own. Null roles and texts are empty; rows without a conv_id are left out; other columns are
    not looked at; without conversations there is no node. With `rebuilt`, conversations take over turns of others first, see inherit(). A
    conversation of any length is spread over tasks. hash_bits and base only change how often hashes collide, not the result.
    """
    narrow = turns(conversations, hash_bits)
    numbered = prefix_scan(narrow.withColumn("zero", F.lit(0).cast("long")), "conv_id", ["turn", "content", "copy"], "zero", "turns")
    numbered = numbered.select("conv_id", (F.col("d") - 1).alias("pos"), "content", "copy", "n")
    lengths = numbered.groupBy("conv_id").agg(F.count("*").alias("length"))
    paths = numbered
    if rebuilt:
        paths, lengths = inherit(numbered, lengths)
    lengths = materialize(lengths, "lengths")
    mixed = paths.withColumn("t", F.xxhash64("content", "copy") if base != 1 else F.col("content") % 8)
    scanned = prefix_scan(mixed, "conv_id", ["pos"], "t", "fingerprints", base)
    none = [F.lit(0).cast("long").alias(c) for c in ("split", "split_at", "p_split", "p_split_at")]
    rows = materialize(scanned.select("conv_id", "d", F.col("h").alias("f"), "p", "content", "copy", "n", *none), "trie-rows")
    rows, nodes = _verified(rows)

    zero = F.lit(0).cast("long")
    top = lengths.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = top.select(*(zero.alias(c) for c in NODE), "n_convs", "conv_id", zero.alias("n"))
    marks = nodes.selectExpr(*PARENT, "1L AS n_children")
    both = nodes.select(*NODE, "n_convs", "conv_id", "n", "p", "p_split", "p_split_at").unionByName(root, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
    pick = [F.max(c).alias(c) for c in ("n_convs", "conv_id", "n", "p", "p_split", "p_split_at")]
    tree = both.groupBy(*NODE).agg(*pick, F.coalesce(F.sum("n_children"), zero).alias("n_children"))
    tree = materialize(tree.withColumn("saved", (F.col("n_convs") - 1) * F.col("n")), "tree")

    # A representative brings its chain's sum, and its leaf if it has one, to every node of its path.
    chains = tree.groupBy("conv_id").agg(F.sum("saved").alias("total"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")).where("total > 0 or leaf > 0")
    rolled = rows.select(*NODE, "conv_id").join(chains, "conv_id").groupBy(*NODE).agg(F.sum("total").alias("total"), F.sum("leaf").alias("leaves"))
    whole = tree.agg(F.sum("saved").alias("total"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves")).where("leaves is not null")
    rolled = rolled.unionByName(whole.select(*(zero.alias(c) for c in NODE), "total", "leaves"))
    # Its own nodes lie below only a part of its chain. A node of one conversation saves nothing, so its place in the chain does not matter.
    above = prefix_scan(tree.where("n_convs > 1").select("conv_id", "saved", *NODE).withColumnRenamed("d", "depth"), "conv_id", ["depth"], "saved", "chains")
    above = above.select(F.col("depth").alias("d"), *NODE[1:], F.col("p").alias("above"))
    ends = rows.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("node")).select("conv_id", "node.*")
    ends = ends.unionByName(lengths.where("length = 0").select("conv_id", *(zero.alias(c) for c in NODE)))
    parts = tree.select(*NODE, "n_convs", "conv_id", "n_children", "p", "p_split", "p_split_at")
    for more in (rolled, above, _digests(ends)):
        parts = parts.unionByName(more, allowMissingColumns=True)
    values = [c for c in parts.columns if c not in NODE]
    full = parts.groupBy(*NODE).agg(*(F.max(c).alias(c) for c in values))
    full = full.withColumn("saved_tokens", F.when(F.col("n_convs") > 1, F.col("total") - F.coalesce("above", zero)).otherwise(zero))
    upper = tree.where("d > 0 and n_children > 0").select((F.col("d") + 1).alias("d"), F.col("f").alias("p"), F.col("split").alias("p_split"), F.col("split_at").alias("p_split_at"), F.col("conv_id").alias("up"))
    # The root's children meet nobody here, so they need not come together.
    full = full.withColumn("p", F.when(F.col("d") == 1, F.col("f")).otherwise(F.col("p")))
    found = full.join(upper, ["d", "p", "p_split", "p_split_at"], "left").join(F.broadcast(top.select(F.col("conv_id").alias("top"))))
    parent = F.when(F.col("d") == 1, F.col("top")).otherwise(F.col("up"))
    return found.select(
        "conv_id", F.col("d").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), "saved_tokens",
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
