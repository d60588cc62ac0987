"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic regressions; each also sees the probabilities of the
categories before it. In training these are out-of-fold, so that a later model learns how far to trust an
earlier one on texts that it has not seen.

What the models see are a few sums over a text's telling words. A word tells by itself or by how it begins: whole
words and beginnings of 4 to 8 characters are weighed by the log odds of toxic texts among those that hold them, in
every language alike. For a text of the learning sample the weights come from the other folds only. All words and
beginnings over a threshold of significance count, however many there are.

Weights and models are learnt from at most `SAMPLE_ROWS` labelled rows; scoring runs over every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pennyworks.llm.common import fold_of, materialize

#: Bound of the learning sample: labelled rows outside the held-out fold, taken in the order of a hash of the id.
SAMPLE_ROWS = 20_000
#: Tasks that the sample is dealt to.
SAMPLE_PARTS = 24
FOLDS = 5
#: Toxic texts that hold a telling word, at least, as a number and as a share of all in the sample; standard errors that are taken off its log odds.
MIN_TEXTS, MIN_SHARE, SURE = 2, 0.01, 2.5
#: Of a threshold, besides ten texts and a tenth of the toxic ones over it: the least precision, and the largest share of clean texts over it, out of fold. Where no threshold has all that, nothing is predicted toxic.
PRECISE, FALSE_SHARE = 0.8, 0.02
BEGINNINGS = range(4, 9)
#: Categories before `toxic` where the labels have none: toxic texts in which telling words are dense, and many.
DERIVED = ("severe", "insistent")
SUMS = 6
#: Characters of the words that a task remembers the weights of.
REMEMBERED = 2_000_000

_WORD = re.compile(r"\w+")
Weights = dict[str, float]


def grams(word: str) -> list[str]:
    """The word and its beginnings; a beginning is marked, so that it is not taken for a word."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if k < len(word))]


class _Weighed(dict):
    """The weight of a word, the largest of its grams, or 0."""

    def __init__(self, weights: Weights):
        self.weights, self.size = weights, 0
        self.heads = {g[: BEGINNINGS.start] for g in weights}

    def __missing__(self, word: str) -> float:
        value = max(self.weights.get(g, 0.0) for g in grams(word)) if word[: BEGINNINGS.start] in self.heads else 0.0
        if self.size > REMEMBERED:
            self.clear()
            self.size = 0
        if len(word) <= 64:
            self[word] = value
            self.size += len(word)
        return value


def sums(text: str | None, weighed: _Weighed) -> list[float]:
    """Six sums over a text's telling words: their weights, number and largest weight, all words, and shares of these."""
    counts = Counter(_WORD.findall((text or "").lower()))
    n = sum(counts.values())
    total, found, most = 0.0, 0, 0.0
    for word, k in counts.items():
        w = weighed[word]
        if w > 0:
            total, found, most = total + w * k, found + k, max(most, w)
    return [math.log1p(total), math.log1p(found), most, math.log1p(n), 10 * found / max(1, n), math.log1p(100 * total / max(1, n))]


@dataclass(frozen=True)
class Chain:
    """The weights of grams, the scale of the sums, and a model for each category: weights of the sums, of the earlier categories, and a bias."""

    categories: tuple[str, ...]
    grams: Weights
    middle: np.ndarray
    spread: np.ndarray
    weights: tuple[np.ndarray, ...]
    threshold: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One column for each category of the chain."""
        scaled, found = (x - self.middle) / self.spread, []
        for w in self.weights:
            found.append(_sigmoid(_with_earlier(scaled, found) @ w))
        return np.column_stack(found)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _with_earlier(x: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([x, *earlier, np.ones(len(x))])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Newton steps on the penalised log loss; the last column is the bias and is hardly penalised."""
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, categories: tuple[str, ...], weights_of: Weights) -> Chain:
    """labels: one column for each category of the chain, the last being the one that the threshold is for."""
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    scaled = (x - middle) / spread
    weights, earlier = [], []
    for y in labels.T.astype(float):
        full = _with_earlier(scaled, earlier)
        weights.append(logistic(full, y))
        unseen = np.empty(len(x))
        for k in np.unique(fold):
            own, others = fold == k, fold != k
            unseen[own] = _sigmoid(full[own] @ (logistic(full[others], y[others]) if others.any() else weights[-1]))
        earlier.append(unseen)
    return Chain(categories, weights_of, middle, spread, tuple(weights), best_threshold(earlier[-1], labels[:, -1].astype(bool)))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where F1 of the out-of-fold probabilities is best among thresholds that spare clean texts, half-way to the next one below; where none does, nothing is toxic."""
    order = np.argsort(-p, kind="stable")
    hits, over = np.cumsum(y[order]), np.arange(1, len(p) + 1)
    spares = (hits >= max(10, 0.1 * y.sum())) & (hits >= PRECISE * over) & (over - hits <= FALSE_SHARE * (~y).sum())
    ends = np.append(p[order][1:] < p[order][:-1], True) & spares
    if not ends.any() or y.all():
        return math.inf
    k = int(np.where(ends, 2 * hits / (over + y.sum()), 0).argmax())
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + below) / 2)


def _log_odds(t: float, n: float, toxic: float, rows: float) -> float:
    """The weight of a gram that t of n texts that hold it are toxic: what its log odds surely exceed, or 0."""
    odds = math.log((t + 0.5) / (toxic + 1)) - math.log((n - t + 0.5) / (rows - toxic + 1))
    return max(0.0, odds - SURE * math.sqrt(1 / (t + 0.5) + 1 / (n - t + 0.5)))


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, t): in how many of some texts it is."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            t: Counter = Counter()
            for text in batch.column(0).slice(at, 200):
                t.update({g for w in set(_WORD.findall(text.as_py().lower())) for g in grams(w)})
            yield pa.RecordBatch.from_arrays([pa.array(t.keys(), pa.string()), pa.array(t.values(), pa.int64())], names=["gram", "t"])


def _weights(sample: DataFrame) -> tuple[Weights, list[Weights]]:
    """Weights from the whole sample, and for each fold from the others.

    Both collects are of grams that MIN_SHARE of the sample's toxic texts hold, with their counts by fold.
    """
    whole = [(0.0, 0.0)] * FOLDS
    for r in sample.groupBy("fold").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect():  # FOLDS rows
        whole[r.fold] = (float(r.t), float(r.n))
    toxic, rows = sum(t for t, _ in whole), sum(n for _, n in whole)
    least = max(MIN_TEXTS, math.ceil(MIN_SHARE * toxic))
    held = sample.where("toxic = 1").select("text").mapInArrow(_grams_of, "gram string, t long")
    often = {r.gram for r in held.groupBy("gram").agg(F.sum("t").alias("t")).where(F.col("t") >= least).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, t = [Counter() for _ in range(FOLDS)], [Counter() for _ in range(FOLDS)]
        for batch in batches:
            for text, k, bad in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = {g for w in set(_WORD.findall(text.as_py().lower())) for g in grams(w) if g in often}
                n[k].update(own)
                if bad:
                    t[k].update(own)
        for k in range(FOLDS):
            columns = [pa.array(n[k].keys(), pa.string()), pa.array([k] * len(n[k]), pa.int32()), pa.array([t[k][g] for g in n[k]], pa.int64()), pa.array(n[k].values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "fold", "t", "n"])

    counts = sample.select("text", "fold", "toxic").mapInArrow(run, "gram string, fold int, t long, n long")
    folds = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for c in ("t", "n") for k in range(FOLDS)]
    all_of, others = {}, [{} for _ in range(FOLDS)]
    for r in counts.groupBy("gram").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), *folds).collect():
        if r.t >= least and (w := _log_odds(r.t, r.n, toxic, rows)) > 0:
            all_of[r.gram] = w
        for k in range(FOLDS):
            t = r.t - r[f"t{k}"]
            if t >= min(least, MIN_TEXTS) and (w := _log_odds(t, r.n - r[f"n{k}"], toxic - whole[k][0], rows - whole[k][1])) > 0:
                others[k][r.gram] = w
    return all_of, others


def _severity(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The DERIVED categories: toxic texts whose telling words are as dense, or as many, as those of the median toxic text."""
    out = np.zeros((len(x), len(DERIVED)), np.int64)
    told = (toxic > 0) & (x[:, 1] > 0)
    for k, column in enumerate((4, 1)):
        if told.any():
            out[:, k] = told & (x[:, column] >= np.median(x[told, column]))
    return out


def learn(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, categories: tuple[str, ...] = ()) -> Chain:
    """Fit on the labels outside fold 0. `categories` names 0/1 columns of labels that come before `toxic` in the chain."""
    known = labels.where("doc_id is not null and toxic is not null").where(fold_of(F.col("doc_id")) != 0)
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in (*categories, "toxic")])
    marks = [F.max(c).alias(c) for c in (*categories, "toxic")]
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).groupBy("doc_id").agg(*marks)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")  # equal texts share a fold
    found = materialize(texts.join(F.broadcast(known), "doc_id").withColumn("fold", fold), "toxic-sample")
    once = found.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    sample = materialize(found.join(F.broadcast(once), "doc_id", "left_semi").repartition(SAMPLE_PARTS, "doc_id"), "toxic-texts")  # at most sample_rows ids
    own, others = _weights(sample)
    chain = (*(categories or DERIVED), "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighed = [_Weighed(w) for w in others]
        for batch in batches:
            x = [sums(text.as_py(), weighed[k]) for text, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), *batch.columns[1:]], names=["x", "fold", "doc_id", *categories, "toxic"])

    marked = sample.select("text", "fold", "doc_id", *categories, "toxic")
    rows = marked.mapInArrow(run, "x array<double>, fold int, doc_id long" + "".join(f", `{c}` int" for c in (*categories, "toxic"))).collect()
    if not rows:
        bias = [np.append(np.zeros(SUMS + k), -3.0) for k in range(len(chain))]
        return Chain(chain, own, np.zeros(SUMS), np.ones(SUMS), tuple(bias), 0.5)
    rows.sort(key=lambda r: (r.doc_id, r.x))  # sums of floats must not depend on the order that rows arrive in
    x = np.array([r.x for r in rows])
    toxic = np.array([r.toxic for r in rows], dtype=np.int64)
    before = np.array([[r[c] for c in categories] for r in rows], dtype=np.int64) if categories else _severity(x, toxic)
    return fit_chain(x, np.column_stack([before, toxic]), np.array([r.fold for r in rows]), chain, own)


def classify(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, categories: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, a probability for each category, score (that of toxic) and predicted for every row of documents.

    A null or empty text has no words and scores accordingly; a text is read whole, however long. Nulls in doc_id give
    held_out false; repeated rows and equal texts score alike; an id that labels repeat is what any of its rows says; an empty
    table gives an empty result; without labels nothing is predicted toxic; other columns are not looked at.
    """
    chain = learn(documents, labels, sample_rows, categories)
    names = [f"p{k}" for k in range(len(chain.categories))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighed = _Weighed(chain.grams)
        for batch in batches:
            x = np.array([sums(text.as_py(), weighed) for text in batch.column(1)]).reshape(-1, SUMS)
            p = chain.probabilities(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(len(names)))], names=["doc_id", *names])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in names))
    held_out: Column = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), F.col(names[-1]).alias("score"), (F.col(names[-1]) >= chain.threshold).cast("int").alias("predicted"),
        *[F.col(n).alias(f"p_{c}") for n, c in zip(names[:-1], chain.categories[:-1], strict=True)],
    )
