"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding by a UTF-8 state machine.

A sequence of tokens is what the merges make of its bytes if, and only if, that holds for every two neighbours in it. So a
transducer that reads bytes, spells tokens along a trie and may end one only where it fits the token before has exactly one
run for each input. It is made deterministic while it reads: a state is the set of runs that are still open, each with the tokens
that it holds back, and an arc emits what all of them agree on. Runs disagree over less than the longest token, so
that many bytes are the most that are looked ahead. States and arcs are built when they are first met and forgotten when they are too many.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"
#: Arcs and pairs of tokens that a task remembers, and four times the pieces; beyond it they are forgotten and built again. Bounds memory, changes no result.
MOST_ARCS = 600_000
#: Characters of text that are turned to ids before a batch of rows is handed on.
SLICE_CHARS = 4_000_000

_NONE = -1
#: An open run: its place in the trie, the last token that it ended, and the tokens that it holds back.
Run = tuple[int, int, tuple[int, ...]]


class Transducer:
    """ranks: every token's bytes, each single byte among them, with its id, which is its rank among merges too."""

    def __init__(self, ranks: dict[bytes, int], most: int = MOST_ARCS):
        self.ranks, self.most = ranks, most
        self.spelling = {i: token for token, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.token, self.inner = [_NONE], [True]
        for token, i in ranks.items():
            at = 0
            for byte in token:
                self.inner[at] = True
                if (at := self.child.setdefault(at << 8 | byte, len(self.token))) == len(self.token):
                    self.token.append(_NONE)
                    self.inner.append(False)
            self.token[at] = i
        self._fits: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[Run, ...]] = []
        self.numbers: dict[tuple[Run, ...], int] = {}
        self.shared: dict[Run, Run] = {}
        self.arcs: dict[int, int] = {}  # from state and byte: twice the next state, and 1 more if tokens leave
        self.leave: dict[int, tuple[int, ...]] = {}
        self._number([(0, _NONE, ())])

    def _number(self, runs: list[Run]) -> int:
        state = tuple([self.shared.setdefault(r, r) for r in runs])
        if (number := self.numbers.setdefault(state, len(self.states))) == len(self.states):
            self.states.append(state)
        return number

    def merged(self, piece: bytes) -> list[int]:
        """What the merges make of a short piece: always the pair of the least rank, the first such."""
        get, none = self.ranks.get, len(self.ranks) + 256
        parts = [piece[k : k + 1] for k in range(len(piece))]
        pairs = [get(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
        while pairs and (least := min(pairs)) < none:
            k = pairs.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = get(parts[k] + parts[k + 1], none)
            if k:
                pairs[k - 1] = get(parts[k - 1] + parts[k], none)
        return [self.ranks[x] for x in parts]

    def fits(self, last: int, token: int) -> bool:
        """Whether the merges leave the two tokens beside each other as they are; at the start, the token alone."""
        key = last << 32 | token
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) >= self.most:
                self._fits.clear()
            whole = [token] if last == _NONE else [last, token]
            raw = b"".join([self.spelling[t] for t in whole])
            one = self.ranks.get(raw, token)
            found = self._fits[key] = not (one != token and self.fits(_NONE, one)) and self.merged(raw) == whole
        return found

    def _arc(self, at: int, byte: int) -> int:
        """Follow every open run by one byte; emit the tokens that all that remain begin with."""
        runs, ended, out, state = [], None, (), self.states[at]
        child, tokens, inner = self.child, self.token, self.inner
        for node, last, held in state:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            token = tokens[node]
            if token != _NONE and ended is None and self.fits(last, token):
                out = (*held, token)
                ended = (0, token, out)
            if inner[node]:
                runs.append((node, last, held))
        same = len(out)
        for _, _, held in runs:
            same = min(same, len(held))
            while held[:same] != out[:same]:
                same -= 1
        runs.append(ended)
        if same:
            runs = [(node, last, held[same:]) for node, last, held in runs]
        if len(self.arcs) >= self.most:
            self._forget()
            at = self._number(state)
        arc = self._number(runs) << 1 | (same > 0)
        self.arcs[at << 8 | byte] = arc
        if same:
            self.leave[at << 8 | byte] = out[:same]
        return arc

    def run(self, piece: Iterable[int]) -> Iterator[int]:
        """The ids of a piece's bytes, each as soon as it is certain."""
        at = 0
        for byte in piece:
            at, out = self.follow(at, (byte,))
            yield from out
        yield from self.states[at][-1][2]

    def follow(self, at: int, piece: Iterable[int]) -> tuple[int, list[int]]:
        """The state after some bytes, and the ids that have left."""
        found, arcs = [], self.arcs
        for byte in piece:
            key = at << 8 | byte
            arc = arcs.get(key)
            if arc is None:
                state = self.states[at]
                arc = self._arc(at, byte)
                if arcs is not self.arcs:  # all was forgotten but this state
                    arcs, key = self.arcs, self.numbers[state] << 8 | byte
            at = arc >> 1
            if arc & 1:
                found += self.leave[key]
        return at, found

    def ids(self, piece: bytes) -> tuple[int, ...]:
        """All that run() gives, for a piece that is there as a whole."""
        at, found = self.follow(0, piece)
        return (*found, *self.states[at][-1][2])


class _Pieces(dict):
    """Packed ids of pieces in two generations: when the younger is full it becomes the older one, which forgets what was not met again."""

    def __init__(self, find, most: int):
        super().__init__()
        self.find, self.most, self.older = find, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece) or self.find(piece)
        if len(piece) <= 32:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Texts to ids: pieces by the pattern, each through the transducer; a piece that is a token is that token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = MOST_ARCS):
        import regex

        self.transducer, self.pattern = Transducer(ranks, most), regex.compile(pattern)
        self.known = _Pieces(self._piece, most // 4)

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.transducer.ranks.get(raw)
        ids = (whole,) if whole is not None else self.transducer.ids(raw)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        pieces = self.pattern.findall(text) if len(text) < 1_000_000 else (m[0] for m in self.pattern.finditer(text))
        return b"".join(map(self.known.__getitem__, pieces))


# Lead bytes of UTF-8, with the number of bytes that follow and the range of the first of these.
_LEADS = (
    (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF),
    (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F),
)
_FOLLOW = {b: (n, low, high) for first, last, n, low, high in _LEADS for b in range(first, last + 1)}
LOST = "\ufffd"


def utf8_step(held: bytes, byte: int) -> tuple[str, bytes]:
    """One step of the state machine, whose state is the unfinished character: what is now certain, and the next state."""
    if held:
        n, low, high = _FOLLOW[held[0]]
        if len(held) > 1:
            low, high = 0x80, 0xBF
        if low <= byte <= high:
            held += bytes((byte,))
            return (held.decode(), b"") if len(held) > n else ("", held)
        text, held = utf8_step(b"", byte)
        return LOST + text, held
    if byte < 0x80:
        return chr(byte), b""
    return ("", bytes((byte,))) if byte in _FOLLOW else (LOST, b"")


class Decoder:
    """Ids to text, token by token. What a token does in a state is worked out byte by byte when it is first met there."""

    def __init__(self, spelling: dict[int, bytes], most: int = MOST_ARCS):
        self.spelling, self.most = spelling, most
        self.arcs: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self.whole = {i: raw.decode() for i, raw in spelling.items() if self._step(b"", i)[1] == b"" and self._step(b"", i)[0].encode() == raw}

    def _step(self, held: bytes, token: int) -> tuple[str, bytes]:
        text, state = [], held
        for byte in self.spelling.get(token, b"\xff"):  # no character begins with this byte: an unknown id is a lost one
            out, state = utf8_step(state, byte)
            text.append(out)
        return "".join(text), state

    def _arc(self, held: bytes, token: int) -> tuple[str, bytes]:
        if len(self.arcs) >= self.most:
            self.arcs.clear()
        self.arcs[held, token] = arc = self._step(held, token)
        return arc

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of each id as far as it ends in whole characters."""
        held = b""
        for token in ids:
            text, held = self.arcs.get((held, token)) or self._arc(held, token)
            yield text
        if held:
            yield LOST

    def decode(self, ids: list[int]) -> str:
        try:  # tokens of whole characters leave the machine where it starts
            return "".join(map(self.whole.__getitem__, ids))
        except KeyError:
            return "".join(self.stream(ids))


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(RANKS)
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def _encoder(path: str | None) -> Encoder:
    import public_tokenizers

    return Encoder(read_ranks(path), public_tokenizers.PATTERN)


@cache
def _decoder(path: str | None) -> Decoder:
    return Decoder({i: token for token, i in read_ranks(path).items()})


def _slices(batch: pa.RecordBatch, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, of about SLICE_CHARS together or one alone."""
    start, total = 0, 0
    for k, size in enumerate(sizes):
        if k > start and total + size > SLICE_CHARS:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


def encode(documents: DataFrame, path: str | None = None, back: bool = False) -> DataFrame:
    """(doc_id, text, ids array<int>, packed) for every row of documents(doc_id, text); packed are the ids as little-endian unsigned 32-bit integers.

    With `back` the ids are decoded again where they are made, into `decoded`, as decode() does it. A null or empty text has no ids. Nulls in
    doc_id pass through, repeated rows come back as often as they came, an empty table gives an empty result, other columns are not looked at. Texts
    are read whole; a task holds one slice of rows, and of a very long text the text and its ids. No two token sequences tie: a text has one.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, text string, ids array<int>, packed binary" + ", decoded string" * back

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(path), _decoder(path) if back else None
        for batch in batches:
            for part in _slices(batch, [len(t.as_py() or "") for t in batch.column(1)]):
                packed = [encoder.encode(t.as_py() or "") for t in part.column(1)]
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])])
                ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                texts = [pa.array([decoder.decode(np.frombuffer(x, "<u4").tolist()) for x in packed], pa.string())] if back else []
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(packed, pa.binary()), *texts], names=names)

    names = [c.split()[0] for c in schema.split(", ")]
    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded(ids, ...) with `decoded`, the text of the ids, a column that must not be one of its own.

    Null or no ids decode to an empty text; bytes that are no UTF-8 and ids that the vocabulary lacks (null ones too) to U+FFFD. Other columns
    stay, whatever they are called, repeated rows come back as often as they came, an empty table gives an empty result.
    """
    names = encoded.columns
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(path)
        for batch in batches:
            lists = batch.column(at)
            for part in _slices(batch, [4 * len(x) if x.is_valid else 0 for x in lists]):
                texts = [decoder.decode(x.values.fill_null(-1).to_pylist() if x.is_valid else []) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, encoded.select("*", F.lit("").alias("decoded")).schema)
