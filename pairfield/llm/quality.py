"""Quality classifier: supervised subword embeddings, averaged per document, softmax output, numpy gradient descent."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .arrays import character_grams, pieces, word_hashes
from .common import fold, per_text, rows_where, table
from .training import labels_outside, texts_of, thinned

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Labelled documents to train on, about; chosen by a hash of the id.
TRAIN_ROWS = 4_000
BUCKETS, WIDTH, EPOCHS, RATE, SEED = 1 << 16, 10, 6, 0.4, 7
#: Character n-grams of a word between boundary marks; the words themselves are features too.
GRAMS = (2, 3, 4)
#: Features that are not hashed: one that every document has, and adjacent pairs of equal words, which count more.
ALWAYS, SAME = BUCKETS, BUCKETS + 1
SAME_COUNTS = 4.0


def _word_buckets(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def same_pairs(hashes: np.ndarray) -> int:
    return int(np.count_nonzero(hashes[1:] == hashes[:-1]))


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The document's feature numbers and their shares, which sum to 1."""
    words = word_hashes([text])[0]
    grams, counts, _ = character_grams([text], GRAMS, BUCKETS)
    every = np.bincount(np.concatenate([_word_buckets(words), *(g[c] for g, c in zip(grams, counts, strict=True))]), minlength=BUCKETS + 2).astype(np.float64)
    every[ALWAYS], every[SAME] = 1.0, SAME_COUNTS * same_pairs(words)
    rows = np.flatnonzero(every)
    return rows.astype(np.int32), (every[rows] / every.sum()).astype(np.float32)


def train(samples: list[tuple[bytes, int]]) -> np.ndarray:
    """The difference of the two logits that each feature contributes: its vector times the output weights.

    Stochastic gradient descent on the softmax cross-entropy, one document a step, with a linearly falling rate and
    classes weighted to count alike up to a factor. Without two classes, the scores are the classes' smoothed share.
    """
    n_good = sum(y for _, y in samples)
    if not samples or n_good in (0, len(samples)):
        out = np.zeros(BUCKETS + 2)
        out[:] = math.log((n_good + 1) / (len(samples) - n_good + 1))
        return out
    bags = [bag(t) for t, _ in samples]
    random = np.random.default_rng(SEED)
    vectors = random.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS + 2, WIDTH)).astype(np.float32)
    output = np.zeros((WIDTH, 2), np.float32)
    share = n_good / len(samples)
    class_weight = np.array([min(4.0, 0.5 / (1 - share)), min(4.0, 0.5 / share)])
    steps, step = EPOCHS * len(samples), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(samples)):
            rows, weight = bags[i]
            own = vectors[rows]
            hidden = weight @ own
            logits = hidden @ output
            p = np.exp(logits - logits.max())
            p /= p.sum()
            y = samples[i][1]
            p[y] -= 1
            slope = (p * class_weight[y] * RATE * (1 - step / steps)).astype(np.float32)
            back = output @ slope
            output -= np.outer(hidden, slope)
            vectors[rows] = own - (weight * len(rows) ** 0.5)[:, None] * back
            step += 1
    return (vectors @ (output[:, 1] - output[:, 0])).astype(np.float64)


class Scorer:
    """Scores UTF-8 texts. The average is linear, so each n-gram adds what its feature contributes."""

    def __init__(self, per_feature: np.ndarray):
        self.per_feature = per_feature

    def _grams(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The sum over each text's n-grams, and their number."""
        grams, counts, starts = character_grams(texts, GRAMS, BUCKETS)
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for g, c in zip(grams, counts, strict=True):
            some = np.searchsorted(starts, len(g))  # texts at the end may be shorter than the n-gram
            if some:
                total[:some] += np.add.reduceat(np.where(c, self.per_feature[g], 0.0), starts[:some])
                n[:some] += np.add.reduceat(c.astype(np.int64), starts[:some])
        return total, n

    def __call__(self, texts: list) -> list[float]:
        texts = [t or b"" for t in texts]
        if not texts:
            return []
        words = word_hashes(texts)
        same = SAME_COUNTS * np.array([same_pairs(w) for w in words])
        parts = [pieces(t) for t in texts]
        each = [self._grams(p) for p in ([[q] for ps in parts for q in ps] if any(len(ps) > 1 for ps in parts) else [texts])]
        first = np.cumsum([0, *map(len, parts[:-1])])
        total, n = (np.add.reduceat(np.concatenate([e[i] for e in each]), first) for i in (0, 1))
        total += [self.per_feature[_word_buckets(w)].sum() for w in words]
        total += self.per_feature[ALWAYS] + same * self.per_feature[SAME]
        n += np.array([len(w) for w in words], np.float64) + 1.0 + same
        return (1 / (1 + np.exp(-np.clip(total / n, -60, 60)))).tolist()


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, folds: int = FOLDS, held_out: int = HELD_OUT) -> np.ndarray:
    return train(texts_of(docs, thinned(labels_outside(labels, "quality", folds, held_out), rows, "quality")))


def scores(docs: DataFrame, per_feature: np.ndarray, keys: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The keys, score (0 to 1) and predicted, for each document.

    Null and empty texts have no words and get the score of the feature that every document has. Repeated rows are
    scored each; an empty table gives an empty result; a very long text takes memory in proportion to itself alone. The
    model, of a fixed size, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(per_feature)

    def make():
        score = Scorer(shared.value)
        return lambda texts: (s := score(texts), [int(x >= threshold) for x in s])

    return per_text(docs, "score double, predicted int", make, keys)


def accepted(docs: DataFrame, per_feature: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model predicts to be good, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(per_feature)

    def make():
        score = Scorer(shared.value)
        return lambda texts: [x >= threshold for x in score(texts)]

    return rows_where(docs, make)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
