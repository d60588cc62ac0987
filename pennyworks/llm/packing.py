"""Best-fit packing of tokenized documents into sequences of bounded length.

Every piece is an item with three demands: tokens, one document and attention cost (tokens squared).
A sequence has a capacity for each. Pieces are placed in decreasing length; a piece goes to the open
sequence that fits it under all three and scores best, by the residual norm or by a weighted dot product.

Spark does the tokenizing and deals the pieces (40 bytes each) to shards by a hash; each shard of about
`SHARD_PIECES` pieces is packed alone, which leaves at most one slack sequence per shard.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pennyworks.llm.common import materialize, slices, small_batches

SEQUENCE_TOKENS = 2048
SEPARATOR_ID = 0
SHARD_PIECES = 25_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"

#: Backtracking limits of the fast encoder are met only by such runs; they go to the plain one.
_LONG_BLANK = re.compile(r"\s{5000}")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _plain_encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _added_tokens(path: str) -> tuple[str, ...]:
    """Strings that the vocabulary takes as one token each, wherever they stand in a text."""
    return tuple(t.content for t in _plain_encoder(path).get_added_tokens_decoder().values())


@functools.cache
def _fast_encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, vocabulary: str | None = None, ranks: str | None = None) -> np.ndarray:
    """Ids of the 50k byte-level BPE vocabulary as little-endian unsigned 32-bit integers.

    The rank file holds the same vocabulary without its added tokens; its encoder gives the same ids about five times as fast.
    """
    vocabulary = vocabulary or _vocabulary("byte_bpe_50k.json")
    if _LONG_BLANK.search(text) or any(t in text for t in _added_tokens(vocabulary)):
        return np.array(_plain_encoder(vocabulary).encode(text, add_special_tokens=False).ids, dtype="<u4")
    return np.array(_fast_encoder(ranks or _vocabulary("byte_bpe_50k.tiktoken")).encode_ordinary(text), dtype="<u4")


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but the first, which takes the remainder."""
    first = n % size or size
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def piece_table(docs: DataFrame, max_tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(SEPARATOR_ID)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), max_tokens)):
                    row = (doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()))
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, PIECE_SCHEMA)


def best_fit(
    lengths: np.ndarray,
    max_tokens: int = SEQUENCE_TOKENS,
    max_docs: int | None = None,
    max_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length. Lengths must not exceed max_tokens.

    Open sequences with equal residuals form one state, and a run of equal pieces fills a chosen
    sequence as far as its residuals allow, so the work follows the distinct lengths, not the pieces.
    """
    max_docs, max_cost = max_docs or max_tokens, max_cost or max_tokens**2
    capacity = np.array([max_tokens, max_docs, max_cost], dtype=np.int64)
    scale = np.array(weights)
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    states: dict[tuple[int, int, int], list[np.ndarray]] = {}
    opened = 0
    shortest = int(lengths.min()) if len(lengths) else 0
    distinct, first, counts = np.unique(-lengths[order], return_index=True, return_counts=True)
    residuals = np.empty((0, 3), np.int64)

    def keep(state: np.ndarray, ids: np.ndarray) -> None:
        nonlocal residuals
        key = tuple(int(x) for x in state)
        if key[0] < shortest or key[1] < 1 or key[2] < shortest**2:
            return
        if key in states:
            states[key].append(ids)
        else:
            states[key] = [ids]
            residuals = np.vstack([residuals, state])

    for length, at, left in zip(-distinct, first, counts, strict=True):
        length, at, left = int(length), int(at), int(left)
        demand = np.array([length, 1, length**2], dtype=np.int64)
        if (demand > capacity).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities")
        while left:
            fits = np.flatnonzero((residuals >= demand).all(axis=1))
            if len(fits):
                open_residuals = residuals[fits]
                if rule == "dot":
                    pick = np.argmin((open_residuals / capacity * (demand / capacity) * scale).sum(axis=1))
                else:
                    pick = np.argmin(((((open_residuals - demand) / capacity) ** 2) * scale).sum(axis=1))
                k = int(fits[pick])
                state = residuals[k].copy()
                ids = np.concatenate(states.pop(tuple(int(x) for x in state)))
                residuals = np.delete(residuals, k, axis=0)
            else:
                state, ids = capacity, None
            each = int((state // demand).min())
            want = -(-left // each)
            if ids is None:
                ids = np.arange(opened, opened + want)
                opened += want
            elif want < len(ids):
                keep(state, ids[want:])
                ids = ids[:want]
            placed = min(left, each * len(ids))
            rows = order[at : at + placed]
            sequence[rows] = np.repeat(ids, each)[:placed]
            offset[rows] = max_tokens - state[0] + np.tile(np.arange(each) * length, len(ids))[:placed]
            whole, rest = divmod(placed, each)
            if whole:
                keep(state - demand * each, ids[:whole])
            if rest:
                keep(state - demand * rest, ids[whole:])
            at, left = at + placed, left - placed
    return sequence, offset


def pack(docs: DataFrame, max_tokens: int = SEQUENCE_TOKENS, shard_pieces: int = SHARD_PIECES, **limits) -> DataFrame:
    """Pack all documents (doc_id, text); one row per piece with its sequence and place there.

    A null or empty text is one piece that holds the separator alone. Repeated rows are packed once
    each, ties in length keep a fixed order, a null doc_id is packed like any other, an empty table
    gives an empty result, and columns besides doc_id and text are not looked at. A text is read whole, however long, and
    only cut if it exceeds a sequence.
    """
    pieces = materialize(piece_table(docs, max_tokens), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))  # a count of the written table

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=False, ignore_index=True)
        sequence, offset = best_fit(pdf["length"].to_numpy(np.int64), max_tokens, **limits)
        return pdf.assign(sequence_id=sequence + (shard << 40), offset=offset).drop(columns="shard")

    # The place among the written rows deals repeated rows, too, to all shards; a recomputed task reads the same files.
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    return pieces.withColumn("shard", shard).groupBy("shard").applyInPandas(run, PACKED_SCHEMA)
