"""Toxicity by non-negative positive-unlabelled learning.

A linear NumPy classifier over the words of a text and their beginnings (4 to 6 letters) learns from confirmed toxic
rows (P) and from rows taken without regard to a label (U). With prior p the risk is

    p * mean_P loss(+1)  +  max(0, mean_U loss(-1) - p * mean_P loss(-1)),

so that the toxic rows hidden in U don't pull the classifier down, and the estimate can't fall below zero.

The classifier is fitted on about ``MOST_POSITIVE`` and ``MOST_UNLABELLED`` rows at most, chosen by a hash of the id, and
on the ``FEATURES`` features that tell P from U best; the broadcast model has that many rows at most. The score is
the logistic of the margin, shifted so that 0.7 is where recall^1.5 / share of rows called toxic is largest, a criterion
that needs no negative labels; the margins for this come from folds that the row did not train.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .letters import find, letter_chunks

MOST_POSITIVE = 3_000
MOST_UNLABELLED = 9_000
FEATURES = 10_000
LEAST_ROWS = 3
BEGINNINGS = range(4, 7)
EPOCHS = 200
FOLDS = 4
#: Weight of the sum of absolute weights, as a share of prior / sqrt(confirmed rows).
SPARSE = 0.3
CALLED = 0.7


class Model:
    """Sorted feature hashes with weights, and the intercept."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias

    def score(self, letters) -> np.ndarray:
        row, place = features(letters, self.keys)
        margin = np.bincount(row, self.weights[place], minlength=letters.n) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def word_features(letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature hash, which different word) of the words of some texts, and the different word of each word."""
    hashes, first, which = letters.words()
    size = letters.ends[letters.starts.searchsorted(letters.starts[first])] - letters.starts[first]
    found, word = [hashes], [np.arange(len(hashes))]
    for n in BEGINNINGS:
        long = np.flatnonzero(size >= n)
        start = letters.starts[first[long]]
        found.append(~letters.hash(start, start + n))  # a beginning is another feature than the word of the same letters
        word.append(long)
    return np.concatenate(found), np.concatenate(word), which


def features(letters, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in ``keys``) of every known feature that a text has, each once."""
    hashes, word, which = word_features(letters)
    place, there = find(keys, hashes)
    word, place = word[there], place[there]
    order = np.argsort(word, kind="stable")
    word, place = word[order], place[order]
    at = np.searchsorted(word, np.arange(which.max(initial=-1) + 2))
    n = np.diff(at)[which]
    row = np.repeat(letters.rows, n)
    upto = np.cumsum(n) - n
    both = row * np.int64(len(keys) or 1) + place[np.repeat(at[which], n) + np.arange(n.sum()) - np.repeat(upto, n)]
    both = np.unique(both)
    return both // (len(keys) or 1), both % (len(keys) or 1)


def feature_rows(batches):
    """(h, pos, unl): in how many rows of either kind each feature occurs, a few rows at a time."""
    for batch in batches:
        for rows, letters in letter_chunks(batch, "text"):
            hashes, _, _ = word_features(letters)
            keys = np.unique(hashes)
            row, place = features(letters, keys)
            positive = np.asarray(rows.column("positive").to_pylist(), bool)
            pos = np.bincount(place[positive[row]], minlength=len(keys))
            unl = np.bincount(place[~positive[row]], minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(pos), pa.array(unl)], names=["h", "pos", "unl"])


def sample(rows: DataFrame, n: int, most: int, name: str) -> DataFrame:
    """About ``most`` of ``n`` rows at most, by a hash of id and text, so that rows of one id are drawn each for itself."""
    share = F.pmod(F.xxhash64("doc_id", "text", F.lit(name)), F.lit(1 << 20))
    return rows.where(share < int((1 << 20) * min(1.0, most / max(n, 1))))


def train(indptr: np.ndarray, place: np.ndarray, positive: np.ndarray, prior: float, width: int) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk (Adam, whole sample in each step)."""
    row = np.repeat(np.arange(len(positive)), np.diff(indptr))
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    n_pos, n_unl = max(1, positive.sum()), max(1, (~positive).sum())
    sparse = SPARSE * prior / np.sqrt(n_pos)
    for step in range(1, EPOCHS + 1):
        margin = np.bincount(row, w[place], minlength=len(positive)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        loss = -np.log1p(-np.minimum(p, 1 - 1e-12))  # of calling a row negative
        negative_risk = loss[~positive].mean() - prior * loss[positive].mean()
        slope = np.where(positive, prior * (p - 1) / n_pos, 0.0)
        if negative_risk > 0:
            slope += np.where(positive, -prior * p / n_pos, p / n_unl)
        grad = np.append(np.bincount(place, slope[row], minlength=width), slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        pace = 0.05 / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= pace * (m / (1 - 0.9**step))
        w[:-1] = np.sign(w[:-1]) * np.maximum(0, np.abs(w[:-1]) - np.minimum(pace[:-1], 50) * sparse)
    return w[:-1], w[-1]


def fit(rows: DataFrame) -> Model:
    """A model from ``rows`` (doc_id, text, toxic: 1 confirmed, anything else unknown); null texts are left out.

    Without a confirmed row every score is 0.
    """
    rows = rows.where(F.col("text").isNotNull()).select("doc_id", "text", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("positive"), F.col("toxic").isNotNull().alias("known"))
    size = rows.agg(F.count("*").alias("n"), F.count_if("positive").alias("p"), F.count_if("known").alias("k")).first()
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    if not size.p:
        return empty
    prior = min(0.5, max(1e-3, size.p / size.k))
    confirmed = sample(rows.where("positive"), size.p, MOST_POSITIVE, "positive")
    unlabelled = sample(rows, size.n, MOST_UNLABELLED, "unlabelled").withColumn("positive", F.lit(False))
    learn = confirmed.unionByName(unlabelled).select("doc_id", "text", "positive", F.xxhash64("text").alias("h"))
    learn = learn.dropDuplicates(["positive", "h"]).drop("h").persist()  # copies are no further evidence
    try:
        got = {r.positive: r.n for r in learn.groupBy("positive").agg(F.count("*").alias("n")).collect()}
        n_pos, n_unl = got.get(True, 0), got.get(False, 0)
        if not n_pos or not n_unl:
            return empty
        seen = learn.mapInArrow(feature_rows, "h long, pos long, unl long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))
        a, b = (F.col("pos") + 0.5) / (n_pos + 1.0), (F.col("unl") + 0.5) / (n_unl + 1.0)
        telling = F.abs(F.log(a / b)) / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("unl") + 0.5))
        top = seen.where(F.col("pos") + F.col("unl") >= LEAST_ROWS).orderBy(telling.desc(), "h").limit(FEATURES)
        keys = np.sort(np.asarray(top.select("h").toArrow()["h"].combine_chunks()).view(np.uint64))
        shared = learn.sparkSession.sparkContext.broadcast(keys)

        def placed(batches):
            for batch in batches:
                for part, letters in letter_chunks(batch, "text"):
                    row, place = features(letters, shared.value)
                    at = np.searchsorted(row, np.arange(letters.n + 1)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(at), pa.array(place.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column("positive"), part.column("doc_id"), lists], names=["positive", "doc_id", "places"])

        data = learn.mapInArrow(placed, learn.select("positive", "doc_id").withColumn("places", F.array().cast("array<int>")).schema).orderBy("positive", "doc_id").toArrow()
    finally:
        learn.unpersist()
    positive = np.asarray(data["positive"].combine_chunks().to_pylist(), bool)
    lists = data["places"].combine_chunks()
    indptr, place = np.asarray(lists.offsets).astype(np.int64), np.asarray(lists.flatten())
    weights, bias = train(indptr, place, positive, prior, len(keys))
    fold, margin = np.arange(len(positive)) % FOLDS, np.zeros(len(positive))
    row = np.repeat(np.arange(len(positive)), np.diff(indptr))
    for k in range(FOLDS):
        other = fold != k
        at = np.concatenate([[0], np.cumsum(np.diff(indptr)[other])])
        w, b = train(at, place[other[row]], positive[other], prior, len(keys))
        own = ~other[row]
        margin += np.where(other, 0, np.bincount(row[own], w[place[own]], minlength=len(positive)) + b)
    return Model(keys, weights, bias - cut(margin, positive) + np.log(CALLED / (1 - CALLED)))


def cut(margin: np.ndarray, positive: np.ndarray) -> float:
    """The margin from which on rows are called toxic: largest recall^1.5 / P(called), in the middle of its gap."""
    order = np.argsort(-margin, kind="stable")
    m = margin[order]
    recall = np.cumsum(positive[order]) / max(1, positive.sum())
    called = np.cumsum(~positive[order]) / max(1, (~positive).sum())
    gain = np.where(np.append(m[1:] < m[:-1], True), recall**1.5 / np.maximum(called, 1 / len(m)), 0)
    best = int(np.argmax(gain))
    return float(m[best] + m[best + 1]) / 2 if best + 1 < len(m) else float(m[best])


def scored(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A score for each row of ``docs``; a null or empty text has that of a text without features."""
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        known, found = Model(*shared.value), [np.zeros(0)]
        for _, letters in letter_chunks(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            found.append(known.score(letters))
        return pa.array(np.concatenate(found))

    return score(F.col(text))
