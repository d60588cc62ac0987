"""Self-join of documents on the Jaccard similarity of their word 5-gram sets, exact.

1. Every text becomes a set of 64-bit shingle hashes. Equal sets are one set from here on.
2. Two sets that reach the threshold share a shingle among the first 25 % of each in any common order.
   The order is by hash, with shingles that many documents share put last, so that a passage which
   half the corpus quotes forms no candidates unless a text consists of it.
3. Sets with a common prefix shingle form a tile. In some rounds each member is held against one leader of
   its tile, which joins groups of near copies with linear work. Tiles whose members are all connected are
   done. In the rest, sets of different components and of the same or a neighbouring size band are
   paired: by a join in small tiles, by blocks of bitmaps in large ones.
4. A pair is weighed by its bitmap signatures: differing bits bound the overlap from above. What may
   still pass is settled by intersecting the sorted hash arrays.
5. Connected components over the links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pennyworks.llm.common import by_size, discard, drop_ids, materialize, slices, small_batches
from pennyworks.llm.components import connected_components

WORDS = 5
#: Similarity as a fraction of whole numbers: 100 * intersection >= 75 * union.
NEED, OF = 75, 100
BITS_A_HASH, MAX_BITS = 4, 4096
#: The order puts a shingle last if it is in the prefix of so many of every eighth document ...
COMMON_FROM, COMMON_SHARE = 3, 8
#: ... and at most so many shingles: the table of common ones is broadcast (8 bytes each).
COMMON_MOST = 1 << 20

#: Rounds of leaders, each the least set of its tile after an exclusive or with one of these.
LEADER_MASKS = (0, 0x5DEECE66D1CE4E5B)
#: Members that are not of a tile's largest component are paired by a join up to so many rows of a tile, and by blocks beyond it.
SMALL_TILE, BLOCK_ROWS = 32, 2_048
#: Lowest large tiles of a set that its rows list, so that a pair is not found again in each tile that it shares.
TILES_LISTED = 64

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


#: Words whose hashes a task remembers, and their length at most.
WORDS_REMEMBERED, WORD_BYTES = 150_000, 64


class _WordHashes(dict):
    """Some MB at most, whatever the texts."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= WORD_BYTES:
            if len(self) >= WORDS_REMEMBERED:
                self.clear()
            self[word] = value
        return value


def shingles(text: str | None, words: _WordHashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's 5-word shingles; of all words if there are fewer."""
    words = _WordHashes() if words is None else words
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and ASCII spaces only
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter((words[w] for w in found), np.uint64, len(found))
    size = min(WORDS, len(h))
    n = len(h) - size + 1
    mixed = np.full(n, size, np.uint64)
    for k in range(size):
        mixed += h[k : k + n] * _MULTIPLIERS[k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def set_id(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.75 n) + 1 hashes in the common order."""
    n = len(hashes)
    length = n - -(-NEED * n // OF) + 1 if n else 0
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        last = common[at] == hashes
        hashes = np.concatenate([hashes[~last], hashes[last]])
    return hashes[:length]


def bitmap(hashes: np.ndarray) -> bytes:
    """One bit per hash, in a power of two of at least BITS_A_HASH bits a hash, up to MAX_BITS."""
    width = min(MAX_BITS, max(64, 1 << (BITS_A_HASH * max(1, len(hashes)) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_overlap(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes) -> int:
    """An upper bound of the intersection: each differing bit is owed to a hash that only one side has."""
    if len(bits_a) < len(bits_b):
        bits_a, bits_b = bits_b, bits_a
    x, y, width = int.from_bytes(bits_a, "little"), int.from_bytes(bits_b, "little"), 8 * len(bits_a)
    while width > 8 * len(bits_b):
        width //= 2
        x = (x >> width) | (x & ((1 << width) - 1))
    return (n_a + n_b - (x ^ y).bit_count()) // 2


def _profiles(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(doc_id, sid, n, bits, prefix) per row; rows without a doc_id or words have no prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, seen = _WordHashes(), shared.value, set()
        for batch in slices(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = shingles(text.as_py(), words)
                sid = set_id(hashes)
                head = prefix(hashes, last) if doc_id is not None and sid not in seen else hashes[:0]
                if doc_id is not None and len(seen) < 20_000:
                    seen.add(sid)  # a copy in the same task needs no second prefix
                for column, value in zip(rows, (doc_id, sid, len(hashes), bitmap(hashes), head.view(np.int64)), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["doc_id", "sid", "n", "bits", "prefix"])

    return small_batches(docs).mapInArrow(run, "doc_id long, sid long, n long, bits binary, prefix array<long>")


def _common(docs: DataFrame) -> np.ndarray:
    """Hashes to put last. Any choice gives the same links; this one keeps tiles small."""
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(COMMON_SHARE)) == 0)
    entries = _profiles(part, np.empty(0, np.uint64)).select(F.explode("prefix").alias("s"))
    counted = materialize(entries.groupBy("s").count().where(F.col("count") >= COMMON_FROM), "common-shingles")
    steps = counted.groupBy(F.floor(F.log2("count") * 4).alias("step")).count().orderBy(F.desc("step")).collect()  # a few hundred at most
    total, least = 0, None
    for step, n in steps:
        total += n
        if total > COMMON_MOST:
            break
        least = step
    if least is None:
        return np.empty(0, np.uint64)
    rows = counted.where(F.floor(F.log2("count") * 4) >= least).select("s").toArrow()
    return np.sort(rows.column("s").to_numpy().astype(np.int64).view(np.uint64))


def _may_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        a, na, ba, b, nb, bb = (c.to_pylist() for c in batch.columns)
        ok = [(OF + NEED) * most_overlap(*x) >= NEED * (x[0] + x[2]) for x in zip(na, ba, nb, bb, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


class _Join:
    """The tables that both rounds of candidates are verified with."""

    def __init__(self, docs: DataFrame, profiles: DataFrame, tiles: DataFrame):
        self.docs, self.used = docs, []
        members = tiles.select("sid").distinct()
        one = profiles.where("doc_id is not null and n > 0").select("sid", "n", "bits", "doc_id").join(members, "sid", "left_semi")
        self.meta = materialize(one.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits")), "set-signatures")

    def _sets(self, pairs: DataFrame) -> DataFrame:
        """(sid, n, hashes) of the sets in pairs, built again from the texts."""
        sids = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
        wanted = materialize(self.meta.select("sid", "doc_id").join(sids, "sid", "left_semi"), "wanted-sets")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = _WordHashes()
            for batch in slices(batches):
                found = [shingles(text.as_py(), words) for text in batch.column(1)]
                keep = [k for k, (h, sid) in enumerate(zip(found, batch.column(0).to_pylist(), strict=True)) if set_id(h) == sid]
                sid = batch.column(0).take(pa.array(keep, pa.int64()))
                hashes = pa.array([found[k].view(np.int64) for k in keep], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([sid, hashes], names=["sid", "hashes"])

        texts = self.docs.join(by_size(wanted), "doc_id").select("sid", "text")
        sets = materialize(small_batches(texts).mapInArrow(run, "sid long, hashes array<long>"), "shingle-sets")
        self.used += [wanted, sets]
        return sets if sets.count() <= wanted.count() else sets.dropDuplicates(["sid"])  # only a repeated doc_id gives a set twice

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs(a, b) that reach the threshold, as a written table."""
        m = self.meta
        a = m.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
        b = m.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
        sized = pairs.join(a, "a").join(b, "b").where(OF * F.least("na", "nb") >= NEED * F.greatest("na", "nb"))
        left = materialize(sized.select("a", "na", "bits_a", "b", "nb", "bits_b").mapInArrow(_may_pass, "a long, b long"), "likely-pairs")
        self.used = [left]
        sets = self._sets(left)
        both = left.join(sets.select(F.col("sid").alias("b"), F.col("hashes").alias("hb")), "b").join(sets.select(F.col("sid").alias("a"), F.col("hashes").alias("ha")), "a")
        shared = F.size(F.array_intersect("ha", "hb"))
        found = materialize(both.where((OF + NEED) * shared >= NEED * (F.size("ha") + F.size("hb"))).select("a", "b"), name)
        discard(*self.used)
        return found


def _tile_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs that may pass by their bitmaps among the rows of two blocks of a large tile, of different components.

    A pair that shares a lower tile among those listed in `own` is left to that one.
    """
    pdf = pdf.reset_index(drop=True)
    same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    width = pdf["bits"].map(len).min()
    folded = [np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 8), axis=0) for x in pdf["bits"]]
    bits, n, c, sid, part = np.array(folded), *(pdf[x].to_numpy() for x in ("n", "c", "sid", "part"))
    largest = pdf["c"].value_counts().index[0]
    tile = pdf["s"].iloc[0]
    lower = [frozenset(x for x in own if x < tile) for own in pdf["own"]]
    found = []
    for k in np.flatnonzero(c != largest):  # each pair of components has a side that is not the largest
        other = c != c[k]
        other &= (sid > sid[k]) | (c == largest)
        if not same:
            other &= part != part[k]
        other &= OF * np.minimum(n, n[k]) >= NEED * np.maximum(n, n[k])
        at = np.flatnonzero(other)
        most = (n[at] + n[k] - np.bitwise_count(bits[at] ^ bits[k]).sum(axis=1, dtype=np.int64)) // 2
        likely = at[(OF + NEED) * most >= NEED * (n[at] + n[k])]
        found += [(min(sid[k], sid[x]), max(sid[k], sid[x])) for x in likely if lower[k].isdisjoint(lower[x])]
    return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def _cross_pairs(live: DataFrame, meta: DataFrame) -> DataFrame:
    """Pairs of sets of one tile, of different components, and of the same or neighbouring size bands."""
    sizes = materialize(live.groupBy("s").agg(F.count("*").alias("rows")).where(F.col("rows") > SMALL_TILE), "large-tiles")
    live = live.join(by_size(sizes), "s", "left").join(meta.select("sid", "n", "bits"), "sid")  # a large tile is not gathered by its key
    small = live.where(F.col("rows").isNull())
    band = F.floor(F.log("n") / F.log(F.lit(OF / NEED))).cast("int")
    x = small.select("s", band.alias("band"), F.col("sid").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"))
    y = small.select("s", F.explode(F.array(band - 1, band, band + 1)).alias("band"), F.col("sid").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"))
    near = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (OF * F.least("na", "nb") >= NEED * F.greatest("na", "nb"))
    joined = x.join(y, ["s", "band"]).where(near).select("a", "b")

    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    large = live.where(F.col("rows").isNotNull()).withColumn("blocks", blocks).withColumn("part", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    own = large.groupBy("sid").agg(F.slice(F.sort_array(F.collect_set("s")), 1, TILES_LISTED).alias("own"))
    large = large.join(own, "sid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select("s", "sid", "c", "n", "bits", "own", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    blocked = large.groupBy("s", "i", "j").applyInPandas(_tile_blocks, "a long, b long")
    return joined.unionByName(blocked).distinct()


def _contracted(components: DataFrame, links: DataFrame) -> DataFrame:
    """Edges that join the components as the links do; each node keeps an edge to its component."""
    return components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links.select("a", "b"))


def _live(tiles: DataFrame, components: DataFrame | None, mask: int) -> DataFrame:
    """(s, sid, c, leader) of the tiles that still hold different components."""
    placed = tiles.select("s", "sid", F.col("sid").alias("c"))
    if components is not None:
        known = components.select(F.col("node").alias("sid"), "component")
        placed = tiles.select("s", "sid").join(known, "sid", "left").select("s", "sid", F.coalesce("component", "sid").alias("c"))
    masked = F.col("sid").bitwiseXOR(F.lit(mask))
    still = placed.groupBy("s").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.min(masked).alias("m")).where("least < most")
    still = still.select("s", F.col("m").bitwiseXOR(F.lit(mask)).alias("leader"))
    return placed.join(still, "s").select("s", "sid", "c", "leader")


def cluster(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) for every row of documents.

    A null or blank text has no shingles and links with nothing; a row without a doc_id links with
    nothing either and has a null component_id. Rows with equal texts share a component, repeated rows
    come back as often as they came, an empty table gives an empty result, and columns besides doc_id and
    text are not looked at. Texts are read whole, however long.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles = materialize(_profiles(docs, _common(docs)), "shingle-profiles")
    entries = profiles.select(F.explode("prefix").alias("s"), "sid")
    tiles = materialize(_live(entries, None, LEADER_MASKS[0]), "tiles")
    verify = _Join(docs, profiles, tiles)
    pair = F.struct(F.least("leader", "sid").alias("a"), F.greatest("leader", "sid").alias("b"))

    roots, tried = None, None
    for k, mask in enumerate(LEADER_MASKS):
        if k:
            before, tiles = tiles, materialize(_live(tiles, roots, mask), "tiles")
            discard(before)
        pairs = tiles.where("sid <> leader").select(pair.alias("p")).select("p.*").distinct()
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti") if k else pairs, "leader-pairs")
        found = verify.links(pairs, "leader-links")
        tried = tried.unionByName(pairs) if k else pairs
        roots = connected_components(found if not k else _contracted(roots, found))
    live = materialize(_live(tiles, roots, 0).drop("leader").distinct(), "open-tiles")
    discard(tiles)
    cross = materialize(_cross_pairs(live, verify.meta).join(tried, ["a", "b"], "left_anti"), "cross-pairs")
    more = verify.links(cross, "cross-links")
    if more.take(1):
        roots = connected_components(_contracted(roots, more))

    rows = profiles.select("doc_id", "n", "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    rows = rows.select("doc_id", "n", F.coalesce("component", "sid").alias("c"))
    heads = rows.where("n > 0 and doc_id is not null").groupBy("c").agg(F.min("doc_id").alias("head"))
    own = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return rows.join(heads, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("head")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(documents: DataFrame) -> DataFrame:
    """documents without those that have a linked document of a lesser doc_id; own columns stay."""
    gone = cluster(documents).where("doc_id <> component_id").select("doc_id").distinct()
    return drop_ids(documents, materialize(gone, "near-copies"))
