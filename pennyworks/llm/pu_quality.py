"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; the unlabelled set is a sample of all documents outside
the held-out fold, with any label hidden. No label of 0 is ever read. The class prior comes from the out-of-fold scores of draft
models: the positives' share among the unlabelled is at most the ratio of the two shares above any score, and the least
ratio is taken. Linear models over binned text statistics then minimise the non-negative unbiased risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

each on all folds but one, and their mean is the model. The risk is taken with PRIOR_SHARE of the estimate: a prior that is too low only
scales the scores of good texts, by its ratio to the true one, while one that is too high leaves no risk of the negative class at all.

The fit runs on the driver over at most `SAMPLE_ROWS` positives and `UNLABELLED_ROWS` others; scoring runs over every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pennyworks.llm.common import fold_of, slices, small_batches

#: Bounds of the two learning samples, of trusted positives and of the unlabelled, taken in the order of a hash of the id.
SAMPLE_ROWS, UNLABELLED_ROWS = 8_000, 8_000
THRESHOLD = 0.3
BINS, FOLDS = 4, 5
#: Share of the estimated prior that the risk is taken with, and the ridge penalty times the number of positives.
PRIOR_SHARE, RIDGE = 0.45, 3.0

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#*$%&|<>@^~=+_{}[]\\/"
_STOP = b".,;:"
_LOUD = b"!?"

FEATURES = (
    "log_words", "word_length", "word_length_spread", "long_words", "short_words", "upper", "digits", "symbols", "stops",
    "loud", "lone_symbols", "symbol_ends", "distinct_words", "commonest_word", "same_as_last", "distinct_pairs",
    "repeated_lines", "words_per_line", "short_lines", "entropy", "capital_words",
)


def features(text: str) -> list[float]:
    """Statistics of one text; all are shares or logarithms, so length alone does not decide."""
    words = _WORD.findall(text)
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    raw = text.encode()
    size = len(raw)
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    frequency = np.fromiter(counts.values(), np.float64, len(counts)) / n
    pairs = set(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    ends = Counter(w[-1] for w in words)
    starts = Counter(w[0] for w in words)
    return [
        math.log1p(n),
        float(lengths.mean()),
        float(lengths.std()),
        float((lengths > 12).mean()),
        float((lengths <= 3).mean()),
        share(_UPPER),
        share(_DIGIT),
        share(_SYMBOL),
        share(_STOP),
        share(_LOUD),
        sum(c for w, c in counts.items() if len(w) == 1 and not w.isalnum()) / n,
        sum(c for e, c in ends.items() if not e.isalnum() and e not in ".,;:!?\"')") / n,
        len(counts) / n * math.log1p(n),
        float(frequency.max()),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(pairs) / max(1, n - 1),
        1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        sum(len(x) < 30 for x in lines) / len(lines),
        float(-(frequency * np.log(frequency)).sum()) / math.log1p(n),
        sum(c for s, c in starts.items() if s.isupper()) / n,
    ]


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t or "") for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


@dataclass(frozen=True)
class Model:
    """Linear over one-hot bins of each feature."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, edges in enumerate(self.edges):
            z += self.weights[j][np.searchsorted(edges, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Smallest ratio of the unlabelled to the positive share above a score: the positives' share."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.5, 13))
    ratios = [(unlabelled >= c).mean() / max((positive >= c).mean(), 1e-9) for c in cuts]
    return float(np.clip(min(ratios), 0.05, 0.95))


def fit_estimated(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """The mean of the folds' models, for the prior that drafts' scores on the folds that they have not seen give."""
    own_p, own_u = np.arange(len(positive)) % FOLDS, np.arange(len(unlabelled)) % FOLDS
    edges = bin_edges(unlabelled)
    if min(len(positive), len(unlabelled)) < 2 * FOLDS:
        return fit(positive, unlabelled, 0.5, edges)
    seen_p, seen_u = np.empty(len(positive)), np.empty(len(unlabelled))
    for k in range(FOLDS):
        draft = fit(positive[own_p != k], unlabelled[own_u != k], 0.5, edges, steps=100)
        seen_p[own_p == k], seen_u[own_u == k] = draft.score(positive[own_p == k]), draft.score(unlabelled[own_u == k])
    prior = best_bin_prior(seen_p, seen_u)
    models = [fit(positive[own_p != k], unlabelled[own_u != k], PRIOR_SHARE * prior, edges) for k in range(FOLDS)]
    return Model(edges, np.mean([m.weights for m in models], axis=0), float(np.mean([m.bias for m in models])), prior)


def bin_edges(unlabelled: np.ndarray) -> np.ndarray:
    """Edges at evenly spaced ranks of the unlabelled and at its tails, where junk sits."""
    ranks = np.unique(np.r_[np.linspace(0, 1, BINS + 1)[1:-1], 0.02, 0.05, 0.95, 0.98])
    return np.quantile(unlabelled, ranks, axis=0).T.copy()


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, edges: np.ndarray, steps: int = 200) -> Model:
    """Minimise the non-negative risk and a ridge penalty by Adam over all rows of both samples at each step."""
    both = np.vstack([positive, unlabelled])
    width, ridge = edges.shape[1] + 1, RIDGE / len(positive)

    def onehot(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(FEATURES) * width), np.float32)
        for j in range(len(FEATURES)):
            out[np.arange(len(x)), j * width + np.searchsorted(edges[j], x[:, j], side="right")] = 1
        return out

    x, n_pos = onehot(both), len(positive)
    w, bias = np.zeros(x.shape[1], np.float32), math.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        s = 1 / (1 + np.exp(-np.clip(x @ w + bias, -40, 40)))
        p, u = s[:n_pos], s[n_pos:]
        negative = -np.log1p(-np.minimum(u, 1 - 1e-6)).mean() + prior * np.log1p(-np.minimum(p, 1 - 1e-6)).mean()
        # Slopes of the losses by the margin: -(1 - s) for a positive, s for a negative.
        slope = np.concatenate([-prior * (1 - p) / n_pos - prior * p / n_pos, u / max(1, len(u))])
        if negative < 0:  # step back up the negative part, as it has gone below what a risk can be
            slope = np.concatenate([prior * p / n_pos, -u / max(1, len(u))])
        g, gb = x.T @ slope.astype(np.float32) + ridge * w, float(slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate, a, b = 0.05 * (1 - step / (steps + 1)), 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= rate * (mb / a) / (math.sqrt(vb / b) + 1e-8)
    return Model(edges, w.reshape(len(FEATURES), width).astype(np.float64), float(bias), prior)


def learn(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Model:
    """Fit on the learning folds. Of the labels only those of 1 outside fold 0 are read."""
    known = labels.where(F.col("doc_id").isNotNull() & (F.col("quality").cast("int") == 1) & (fold_of(F.col("doc_id")) != 0))
    order = F.xxhash64("doc_id")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trusted = known.select(F.col("doc_id").cast("long").alias("doc_id")).orderBy(order).limit(sample_rows)
    web = texts.select("doc_id").where("doc_id is not null").where(fold_of(F.col("doc_id")) != 0)
    web = web.orderBy(order).limit(unlabelled_rows)
    # The two bounds hold for the ids, so the broadcast does not grow with the data.
    chosen = trusted.select("doc_id", F.lit(1).alias("trusted")).unionByName(web.select("doc_id", F.lit(0).alias("trusted")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = _matrix(batch.column(1).to_pylist())
            arrays = [batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["trusted", "x"])

    sample = texts.join(F.broadcast(chosen), "doc_id").select("trusted", "text")
    rows = small_batches(sample).mapInArrow(run, "trusted int, x array<double>").collect()
    rows.sort(key=lambda r: (r.trusted, r.x))  # the folds must not depend on the order that rows arrive in
    shuffled = np.random.default_rng(0).permutation(len(rows))
    rows = [rows[k] for k in shuffled]
    positive = np.array([r.x for r in rows if r.trusted == 1]).reshape(-1, len(FEATURES))
    unlabelled = np.array([r.x for r in rows if r.trusted == 0]).reshape(-1, len(FEATURES))
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros((len(FEATURES), 1)), np.zeros((len(FEATURES), 2)), 0.0, 0.5)
    return fit_estimated(positive, unlabelled)


def score(documents: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """Every row of documents with a column `into`, which must not be one of its own.

    A null or empty text scores by the features of an empty text.
    """
    names = documents.columns
    schema = documents.select("*", F.lit(0.0).alias(into)).schema
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = pa.array(model.score(_matrix(batch.column(at).to_pylist())))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*names, into])

    return small_batches(documents).mapInArrow(run, schema)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of documents.

    Nulls in doc_id give held_out false; repeated rows are scored alike; an empty table gives an empty
    result; without any label of 1 all rows score one half; a score at the threshold is predicted 1; a text is read whole,
    however long; other columns are not looked at.
    """
    scored = score(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learn(documents, labels))
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents that are not rejected, with their own columns, whatever these are called.

    A null or empty text is scored as an empty one; a row without a doc_id is scored like any other; repeated rows are kept
    or rejected alike, and a score at the threshold keeps; texts are read whole; an empty table gives an empty result.
    """
    names, into = documents.columns, "_score"
    while into in names:
        into = "_" + into
    return score(documents, learn(documents, labels), into).where(F.col(into) >= threshold).select(*names)
