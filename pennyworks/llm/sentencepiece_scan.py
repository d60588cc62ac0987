"""SentencePiece encoding by the best path through the piece lattice, and decoding.

A path's score is the sum of its pieces' scores. No piece has a blank after another character, so a text
falls into independent parts before each run of blanks. The parts of many rows that are not known yet are solved together,
all parts of a length in one array. Of equally good paths the one whose last piece is longer is taken, from the end on.

Documents longer than a chunk are cut wherever the chunk ends. Each chunk gives a max-plus matrix from the overhang of the
piece that enters it to the overhang of the one that leaves it. The matrices combine associatively, in two levels: products of
groups of chunks, then of the groups of a document, then the score of every overhang at each chunk's start. With these, each
chunk tells which overhang it is entered by for each one that it is left by; these maps combine in the same two levels,
and every chunk is then backtraced on its own. The ids are those of the text as a whole, wherever it is cut.

Scores are whole numbers (of 2^-20), so that sums do not depend on how a text is cut.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pennyworks.llm.common import materialize

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
#: Documents of more characters are scanned in chunks of so many, and so many chunks are a group.
CHUNK_CHARS, GROUP_CHUNKS = 65_536, 64
#: Rows whose ids a task holds at a time, and the longest parts that are solved together.
ROWS_AT_ONCE, PART_CHARS = 1_000, 40
#: Fewer parts of one length are solved one by one, place by place.
FEW = 24
SCALE = 1 << 20
UNKNOWN_PENALTY = 10
NO_RANK = -1e6
NONE = np.iinfo(np.int64).min // 4

_PARTS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class _Table:
    """Scores and ids of the pieces by a 64-bit hash of their characters, for arrays of hashes: each is in its slot, or among the few others."""

    BITS = 19
    FACTOR, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)

    def __init__(self, pieces: dict[str, tuple[int, int]]):
        # The last entry, at -1, is that of no piece: an unknown character.
        self.ids = np.array([*(i for i, _ in pieces.values()), -1], np.int64)
        self.scores = np.array([*(s for _, s in pieces.values()), NONE], np.int64)
        self.lengths = np.array([*map(len, pieces), 1], np.int64)
        hashes = np.array([self.hash_of(p) for p in pieces], np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have one hash")
        slots, first = np.unique(self._slot(hashes), return_index=True)
        self.keys, self.value = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)
        self.keys[slots], self.value[slots] = hashes[first], first
        others = np.setdiff1d(np.arange(len(hashes)), first)
        order = others[np.argsort(hashes[others])]
        self.other_keys, self.other_values = hashes[order], order.astype(np.int32)
        self.shared = np.zeros(1 << self.BITS, bool)
        self.shared[self._slot(self.other_keys)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * self.FACTOR) >> np.uint64(64 - self.BITS)).view(np.int64)

    def hash_of(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.BASE) + ord(c) + 1) % (1 << 64)
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, or -1."""
        slot = self._slot(h)
        out = np.where(self.keys.take(slot) == h, self.value.take(slot), np.int32(-1))
        again = np.flatnonzero(self.shared.take(slot))
        if len(again) and len(self.other_keys):
            at = np.minimum(np.searchsorted(self.other_keys, h[again]), len(self.other_keys) - 1)
            hit = self.other_keys[at] == h[again]
            out[again[hit]] = self.other_values[at[hit]]
        return out


class Solved:
    """Score and ids of the best path through each of some parts; the ids of all stand one after the other."""

    def __init__(self, parts: list[str], scores: list[np.ndarray], sizes: list[np.ndarray], flat: list[np.ndarray]):
        self.place = dict(zip(parts, range(len(parts)), strict=True))
        self.scores, self.sizes, self.flat = (np.concatenate([np.zeros(0, np.int64), *x]).astype(kind) for x, kind in ((scores, np.int64), (sizes, np.int64), (flat, np.int32)))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __getitem__(self, part: str) -> tuple[int, tuple[int, ...]]:
        k = self.place[part]
        return int(self.scores[k]), tuple(self.flat[self.starts[k] : self.starts[k] + self.sizes[k]].tolist())

    def score(self, parts: list[str]) -> int:
        return int(self.scores[[self.place[p] for p in parts]].sum())

    def ids(self, parts: Iterator[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of n parts, one after the other, and where each ends."""
        at = np.fromiter(map(self.place.__getitem__, parts), np.int64, n)
        own = self.sizes[at]
        ends = np.cumsum(own)
        total = int(ends[-1]) if n else 0
        return self.flat[np.arange(total) + np.repeat(self.starts[at] - (ends - own), own)], ends


class Lattice:
    """Pieces of a model with their scores; an unknown character costs more than any piece and becomes its bytes.

    Pieces without a rank (scores below NO_RANK) come right after the last that has one, all alike.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)  # for the pieces and their scores only
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        raw = {i: sp.get_score(i) for i in ids}
        last = min((x for x in raw.values() if x > NO_RANK), default=0.0) - 1
        self.pieces = {sp.id_to_piece(i): (i, round((x if x > NO_RANK else last) * SCALE)) for i, x in raw.items()}
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("pieces with a blank after another character are not supported")
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        names = {i: p.replace(BLANK, " ").encode() for p, (i, _) in self.pieces.items()} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        every = [names.get(i, b"") for i in range(sp.get_piece_size())]
        self.name_bytes = np.frombuffer(b"".join(every), np.uint8)
        self.name_sizes = np.array([len(x) for x in every], np.int64)
        self.name_starts = np.cumsum(self.name_sizes) - self.name_sizes
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY * SCALE
        self.longest = max(map(len, self.pieces))
        self.table = _Table(self.pieces)
        self.ready = Solved([], [], [], [])

    def options(self, text: str, at: int) -> Iterator[tuple[int, int]]:
        """(length, score) of what can start at a place of text."""
        if text[at] not in self.pieces:
            yield 1, self.unknown
        for length in range(1, min(self.longest, len(text) - at) + 1):
            if piece := self.pieces.get(text[at : at + length]):
                yield length, piece[1]

    def ids(self, piece: str) -> tuple[int, ...]:
        known = self.pieces.get(piece)
        return (known[0],) if known else tuple(self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass"))

    def _forward(self, text: str, n: int, entry: list[int]) -> tuple[list[int], list[int]]:
        """Best score at each place of text, and where its last piece starts (-1: outside), for pieces that start before n.

        entry[i] is the score of a path from outside that ends at place i.
        """
        score, back = [NONE] * (len(text) + 1), [-1] * (len(text) + 1)
        score[: len(entry)] = entry[: len(text) + 1]
        for at in range(n):
            here = score[at]
            if here > NONE // 2:
                for length, s in self.options(text, at):
                    if here + s > score[at + length]:
                        score[at + length], back[at + length] = here + s, at
        return score, back

    def _trace(self, text: str, back: list[int], end: int) -> tuple[list[int], int]:
        """Ids of the path that ends at a place, and where it came in."""
        parts = []
        while back[end] >= 0:
            parts.append(self.ids(text[back[end] : end]))
            end = back[end]
        return [i for part in reversed(parts) for i in part], end

    def path(self, text: str) -> tuple[int, tuple[int, ...]]:
        """Score and ids of the best path through a text, place by place."""
        score, back = self._forward(text, len(text), [0])
        return score[-1], tuple(self._trace(text, back, len(text))[0])

    def _together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As path, for parts of one length: scores, numbers of ids, and the ids of all parts."""
        n, size = len(parts), len(parts[0])
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, size).T.astype(np.uint64)
        with np.errstate(over="ignore"):
            base = self.table.BASE
            power = [np.uint64(1)]
            prefix = [np.zeros(n, np.uint64)]
            for k in range(size):
                power.append(power[-1] * base)
                prefix.append(prefix[-1] * base + codes[k] + np.uint64(1))
            score = np.full((size + 1, n), NONE, np.int64)
            score[0] = 0
            piece = np.full((size + 1, n), -1, np.int32)
            for end in range(1, size + 1):
                for k in range(min(end, self.longest), 0, -1):
                    found = self.table.find(prefix[end] - prefix[end - k] * power[k])
                    total = score[end - k] + self.table.scores[found]  # the last score is that of no piece
                    if k == 1:
                        total[found < 0] = score[end - 1][found < 0] + self.unknown
                    better = total > score[end]
                    np.copyto(score[end], total, where=better)
                    np.copyto(piece[end], found, where=better)
        at, lanes = np.full(n, size), np.arange(n)
        steps, ends = [], []
        while (at > 0).any():
            last = piece[at, lanes]
            steps.append(np.where(at > 0, self.table.ids[last], -2))
            ends.append(at)
            at = np.maximum(0, at - self.table.lengths[last])
        ids, ends = np.array(steps[::-1]).T, np.array(ends[::-1]).T
        counts = (ids >= 0).astype(np.int64)
        unknown = [(lane, step, self.ids(parts[lane][ends[lane, step] - 1])) for lane, step in np.argwhere(ids == -1).tolist()]
        for lane, step, own in unknown:
            counts[lane, step] = len(own)
        flat = np.repeat(ids.ravel(), counts.ravel())
        if unknown:
            starts = (np.cumsum(counts) - counts.ravel()).reshape(counts.shape)
            for lane, step, own in unknown:
                flat[starts[lane, step] : starts[lane, step] + len(own)] = own
        return score[size], counts.sum(axis=1), flat

    def solve(self, parts: set[str]) -> Solved:
        """The best path through each part."""
        by_size: dict[int, list[str]] = {}
        for p in parts:
            by_size.setdefault(len(p), []).append(p)
        order, found = [], []
        for size, own in by_size.items():
            for at in range(0, len(own), 8_192):
                part = own[at : at + 8_192]
                order += part
                if size > PART_CHARS or len(part) < FEW:
                    paths = list(map(self.path, part))
                    found.append((np.array([x for x, _ in paths]), np.array([len(i) for _, i in paths]), np.array([i for _, ids in paths for i in ids])))
                else:
                    found.append(self._together(part))
        return Solved(order, *map(list, zip(*found, strict=True))) if found else Solved([], [], [], [])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has. Blanks are already BLANK."""
        parts = [_PARTS.findall(t) for t in texts]
        solved = self.solve(set(itertools.chain.from_iterable(parts)))
        counts = np.array([len(p) for p in parts], np.int64)
        ids, ends = solved.ids(itertools.chain.from_iterable(parts), int(counts.sum()))
        upto = np.concatenate([[0], ends])[np.cumsum(counts)]
        return ids, np.diff(upto, prepend=0)

    def _cuts(self, body: str) -> tuple[int, int]:
        """First and last place in body at which every path has a boundary; equal if there is one, (0, 0) if none."""
        first = re.search(f"[^{BLANK}]{BLANK}", body)
        if not first:
            return 0, 0
        last = len(body) - 1
        while not (body[last] == BLANK and body[last - 1] != BLANK):
            last -= 1
        return first.start() + 1, last

    def _spread(self, text: str, n: int, starts: int) -> np.ndarray:
        """Best scores from each of the first `starts` places of text to each place from n on."""
        d = np.full((n + self.longest, starts), NONE, np.int64)
        for i in range(min(starts, len(d))):
            d[i, i] = 0
        for at in range(n):
            if (d[at] > NONE // 2).any():
                for length, s in self.options(text, at):
                    np.maximum(d[at + length], d[at] + s, out=d[at + length])
        return d[n : n + self.longest].T

    def prepare(self, bodies: list[str]) -> None:
        """Solve the parts of some chunks together."""
        inside = [body[slice(*self._cuts(body))] for body in bodies]
        self.ready = self.solve(set(itertools.chain.from_iterable(map(_PARTS.findall, inside))))

    def _ready(self, parts: list[str]) -> Solved:
        return self.ready if self.ready.place.keys() >= set(parts) else self.solve(set(parts))

    def transfer(self, body: str, ahead: str) -> np.ndarray:
        """Max-plus matrix of a chunk: best score by the overhang into it and the overhang out of it."""
        a, b = self._cuts(body)
        if not a:
            return self._spread(body + ahead, len(body), self.longest)
        parts = _PARTS.findall(body[a:b])
        middle = self._ready(parts).score(parts)
        into = self._spread(body[:a], a, self.longest)[:, 0]  # no piece reaches over the cut
        out = self._spread(body[b:] + ahead, len(body) - b, 1)[0]
        return np.maximum(into[:, None] + out[None] + middle, NONE)

    def entered(self, body: str, ahead: str, entry: list[int]) -> list[int]:
        """For each overhang out of the chunk, the one into it on the best path, or -1. entry: scores of the overhangs into it."""
        a, _ = self._cuts(body)
        if a:
            _, back = self._forward(body[:a], a, entry)
            return [self._trace(body[:a], back, a)[1]] * self.longest
        score, back = self._forward(body + ahead, len(body), entry)
        ends = range(len(body), len(body) + self.longest)
        return [self._trace(body + ahead, back, e)[1] if e < len(score) and score[e] > NONE // 2 else -1 for e in ends]

    def backtrace(self, body: str, ahead: str, entry: list[int], out: int) -> list[int]:
        """Ids of the pieces that start in the chunk on the best path that leaves it with an overhang."""
        a, b = self._cuts(body)
        if not a:
            _, back = self._forward(body + ahead, len(body), entry)
            return self._trace(body + ahead, back, len(body) + out)[0]
        _, back = self._forward(body[:a], a, entry)
        head = self._trace(body[:a], back, a)[0]
        rest = body[b:] + ahead
        _, back = self._forward(rest, len(body) - b, [0])
        parts = _PARTS.findall(body[a:b])
        return [*head, *self._ready(parts).ids(iter(parts), len(parts))[0].tolist(), *self._trace(rest, back, len(body) - b + out)[0]]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; associative."""
    return np.maximum((a[:, :, None] + b[None]).max(axis=1), NONE)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


@functools.cache
def lattice(path: str | None = None) -> Lattice:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    return Lattice(path)


def escape(text: str) -> str:
    """The model's spelling of a text: a blank in front, and BLANK for each space. A text's own BLANKs read as spaces."""
    return BLANK + text.replace(" ", BLANK) if text else ""


def decode_ids(ids: np.ndarray, sizes: np.ndarray, path: str | None = None) -> list[str]:
    """Texts of some rows' ids, which stand one after the other."""
    own = lattice(path)
    lengths = own.name_sizes[ids]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    raw = own.name_bytes[np.arange(total) + np.repeat(own.name_starts[ids] - (ends - lengths), lengths)].tobytes()
    upto = np.concatenate([[0], ends])[np.cumsum(sizes)].tolist()
    texts = (raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *upto], upto, strict=False))
    return [t[1:] if t.startswith(" ") else t for t in texts]


def _matrix(raw: bytes) -> np.ndarray:
    size = int((len(raw) // 8) ** 0.5)
    return np.frombuffer(raw, np.int64).reshape(size, size)


def _product(pdf: pd.DataFrame) -> pd.DataFrame:
    """The matrix of a group of chunks."""
    pdf = pdf.sort_values("k")
    whole = functools.reduce(combine, map(_matrix, pdf["matrix"]))
    return pd.DataFrame({"row": pdf["row"].iloc[:1], "g": pdf["g"].iloc[:1], "matrix": [whole.tobytes()]})


def _entries(raw: pd.Series, start: np.ndarray) -> list[bytes]:
    """Scores of the overhangs before each of some matrices in order."""
    out = []
    for m in map(_matrix, raw):
        out.append(start.tobytes())
        start = combine(start[None], m)[0]
    return out


def _group_entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Scores of the overhangs before each group of a document. A string has at most 2^31 bytes, so there are some 2,000 groups at most."""
    pdf = pdf.sort_values("g")
    size = len(_matrix(pdf["matrix"].iloc[0]))
    return pd.DataFrame({"row": pdf["row"], "g": pdf["g"], "entry": _entries(pdf["matrix"], np.where(np.arange(size) == 0, 0, NONE))})


def _chunk_entries(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("k")
    return pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "entry": _entries(pdf["matrix"], np.frombuffer(pdf["start"].iloc[0], np.int64))})


def _map_product(pdf: pd.DataFrame) -> pd.DataFrame:
    """The overhang into a group for each one out of it."""
    pdf = pdf.sort_values("k", ascending=False)
    whole = np.arange(len(pdf["into"].iloc[0]))
    for m in pdf["into"]:
        whole = np.where(whole >= 0, np.asarray(m)[whole], -1)
    return pd.DataFrame({"row": pdf["row"].iloc[:1], "g": pdf["g"].iloc[:1], "into": [whole.tolist()]})


def _outs(maps: pd.Series, out: int) -> list[int]:
    """The overhang out of each of some maps, the last first."""
    found = []
    for m in maps:
        found.append(out)
        out = int(m[out])
    return found


def _group_outs(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("g", ascending=False)
    return pd.DataFrame({"row": pdf["row"], "g": pdf["g"], "out": _outs(pdf["into"], 0)})


def _chunk_outs(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("k", ascending=False)
    return pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "out": _outs(pdf["into"], int(pdf["out"].iloc[0]))})


def _giants(docs: DataFrame, chunk: int, path: str | None, group: int) -> DataFrame:
    """(doc_id, text, ids) of long documents, chunk by chunk."""
    docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "giant-documents")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = lattice(path).longest
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = escape(text.as_py())
                for k, at in enumerate(range(0, len(text), chunk)):
                    end = at + chunk
                    columns = [pa.array([row]), pa.array([k], pa.int32()), pa.array([text[at:end]]), pa.array([text[end : end + ahead]])]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "k", "body", "ahead"])

    def each(f, kind: pa.DataType, name: str, *columns: int):
        """row, k and f of the columns; a few rows at a time."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 32):
                    part = batch.slice(at, 32)
                    if name != "into":
                        lattice(path).prepare(part.column(2).to_pylist())
                    found = [f(*x) for x in zip(*(part.column(c).to_pylist() for c in columns), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, kind)], names=["row", "k", name])

        return run

    scores = lambda raw: np.frombuffer(raw, np.int64).tolist()
    weigh = each(lambda b, a: lattice(path).transfer(b, a).tobytes(), pa.binary(), "matrix", 2, 3)
    enter = each(lambda b, a, e: lattice(path).entered(b, a, scores(e)), pa.list_(pa.int32()), "into", 2, 3, 4)
    trace = each(lambda b, a, e, o: lattice(path).backtrace(b, a, scores(e), o), pa.list_(pa.int32()), "ids", 2, 3, 4, 5)
    g = F.floor(F.col("k") / group).cast("int").alias("g")

    chunks = docs.select("row", "text").mapInArrow(cut, "row long, k int, body string, ahead string")
    chunks = materialize(chunks.repartition(F.xxhash64("row", "k")), "chunks")
    matrices = materialize(chunks.mapInArrow(weigh, "row long, k int, matrix binary").select("*", g), "matrices")
    products = matrices.groupBy("row", "g").applyInPandas(_product, "row long, g int, matrix binary")
    starts = products.groupBy("row").applyInPandas(_group_entries, "row long, g int, entry binary").withColumnRenamed("entry", "start")
    entries = matrices.join(starts, ["row", "g"]).groupBy("row", "g").applyInPandas(_chunk_entries, "row long, k int, entry binary")
    entered = materialize(chunks.join(entries, ["row", "k"]).select("row", "k", "body", "ahead", "entry"), "entered-chunks")
    maps = materialize(entered.mapInArrow(enter, "row long, k int, into array<int>").select("*", g), "chunk-maps")
    group_maps = maps.groupBy("row", "g").applyInPandas(_map_product, "row long, g int, into array<int>")
    ends = group_maps.groupBy("row").applyInPandas(_group_outs, "row long, g int, out int")
    outs = maps.join(ends, ["row", "g"]).groupBy("row", "g").applyInPandas(_chunk_outs, "row long, k int, out int")
    traced = entered.join(outs, ["row", "k"]).select("row", "k", "body", "ahead", "entry", "out").mapInArrow(trace, "row long, k int, ids array<int>")
    whole = traced.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return docs.join(whole, "row").select("doc_id", "text", "ids")


def encode(documents: DataFrame, chunk_chars: int = CHUNK_CHARS, path: str | None = None, group_chunks: int = GROUP_CHUNKS) -> DataFrame:
    """(doc_id, text, ids array<int>) for every row of documents(doc_id, text).

    A null or empty text has no ids. Nulls in doc_id pass through, repeated rows come back as often as they
    came, an empty table gives an empty result, other columns are not looked at. Very long texts are scanned in chunks; the ids
    do not depend on their size. Ties between paths go to the longer last piece.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, sizes = lattice(path).encode([escape(t.as_py() or "") for t in batch.column(1)])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["doc_id", "text", "ids"])

    long = F.coalesce(F.length("text"), F.lit(0)) > chunk_chars
    short = docs.where(~long).mapInArrow(run, "doc_id long, text string, ids array<int>")
    return short.unionByName(_giants(docs.where(long), chunk_chars, path, group_chunks)) if docs.where(long).take(1) else short


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded(ids, ...) with `decoded` text and `ids_crc32` of the little-endian unsigned 32-bit ids.

    Null or no ids decode to an empty text; a blank sign of the text's own comes back as a space, since the model has no
    other spelling for it. Other columns stay, repeated rows come back as often as they came, an empty table gives an empty result.
    """
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("ids")
        for batch in _slices(batches):
            column = batch.column(at)
            ids, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.array([x or 0 for x in pc.list_value_length(column).to_pylist()], np.int64)
            texts = decode_ids(ids, sizes, path)
            raw, upto = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
            crc = pa.array([zlib.crc32(raw[a:b]) for a, b in zip([0, *upto], upto, strict=False)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), crc], names=[*names, "decoded", "ids_crc32"])

    kept = encoded.select("*", F.lit("").alias("decoded"), F.lit(0).cast("long").alias("ids_crc32"))
    return encoded.mapInArrow(run, kept.schema)
