"""Toxicity by non-negative positive-unlabelled learning over words and their beginnings."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import NOT_ALNUM, word_starts
from .common import fold, per_text, table
from .training import labels_outside, texts_of, thinned

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Confirmed toxic documents, and labelled ones whose labels are not used, to train on, about; chosen by a hash of the id.
POSITIVE_ROWS, UNLABELLED_ROWS = 2_000, 10_000
BUCKETS, EPOCHS, BATCH, RATE, DECAY, SEED = 1 << 18, 100, 1024, 0.25, 1e-5, 11
#: Only features that so many toxic documents have, more than by chance by so many standard deviations, and of
#: whose documents so large a share is toxic, get a weight.
LEAST_TOXIC, LEAST_SIGMAS, LEAST_SHARE = 4, 3.5, 0.6
#: Beginnings of words that are features besides the words.
STARTS = (3, 4, 5, 6)


def bags(texts: list) -> list[np.ndarray]:
    """For each UTF-8 text, the features of its distinct words, each once; words are in lower case, without punctuation."""
    lower = [(t or b"").decode("utf-8", "replace").lower().encode() for t in texts]
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return [np.unique((h * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int32) for h in word_starts(lower, STARTS, NOT_ALNUM)]


class _Rows:
    """Bags of telling features as one flat array, to take many at once."""

    def __init__(self, bags: list[np.ndarray]):
        self.size = np.array([len(b) for b in bags])
        self.at, self.flat = np.cumsum(self.size) - self.size, np.concatenate(bags)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features of those bags, and for each the place of its bag in which."""
        size = self.size[which]
        row = np.repeat(np.arange(len(which)), size)
        return self.flat[np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.at[which], size)], row


def train(positive: list[bytes], unlabelled: list[bytes], prior: float) -> tuple[np.ndarray, float]:
    """Weights of features and a bias, by mini-batches of the non-negative estimator with the logistic loss.

    The risk is prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)). Where the second term falls below zero, the step goes
    against it instead, so that the model doesn't fit unlabelled texts beyond what the class prior allows. Each
    feature's rate falls with its own gradients. Features were chosen for what toxic texts have more often, so no weight
    falls below zero: the many words of a long text can't outvote a toxic one. Last, the bias is moved so that THRESHOLD meets
    the prior better: see calibrated().
    """
    if not positive or not unlabelled:
        return np.zeros(BUCKETS), math.log((prior + 1e-3) / (1 - prior + 1e-3))
    pos, unl = ([b for at in range(0, len(x), 256) for b in bags(x[at : at + 256])] for x in (positive, unlabelled))
    in_pos, in_unl = (np.bincount(np.concatenate(b), minlength=BUCKETS) for b in (pos, unl))
    by_chance = (in_unl + 1) * (len(pos) / len(unl))
    share = prior * in_pos / by_chance  # of the documents with a feature, toxic ones as estimated
    telling = np.flatnonzero((in_pos >= LEAST_TOXIC) & (in_pos - by_chance > LEAST_SIGMAS * np.sqrt(by_chance + 1)) & (share > LEAST_SHARE))
    if not len(telling):
        return np.zeros(BUCKETS), math.log(prior / (1 - prior))
    number = np.full(BUCKETS, -1)
    number[telling] = np.arange(len(telling))
    pos, unl = (_Rows([number[b][number[b] >= 0] for b in bags]) for bags in (pos, unl))
    random, half, n = np.random.default_rng(SEED), max(1, BATCH // 2), len(telling)
    weights, seen, bias, seen_bias = np.zeros(n), np.full(n, 1e-2), -2.0, 1e-2
    for _ in range(EPOCHS):
        order = random.permutation(len(unl.size))
        for at in range(0, len(order), half):
            us, ps = order[at : at + half], random.integers(0, len(pos.size), half)
            (fu, ru), (fp, rp) = unl.take(us), pos.take(ps)
            zu, zp = (np.clip(np.bincount(r, weights[f], len(k)) + bias, -30, 30) for f, r, k in ((fu, ru, us), (fp, rp, ps)))
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gp, gu = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
            if negative >= 0:  # slopes of the whole risk
                sp, su = np.full(len(ps), -prior / len(ps)), gu / len(us)
            else:  # up the negative term alone
                sp, su = prior * gp / len(ps), -gu / len(us)
            touched = np.bincount(fu, minlength=n) + np.bincount(fp, minlength=n) > 0
            step = np.where(touched, np.bincount(fu, su[ru], n) + np.bincount(fp, sp[rp], n) + DECAY * weights, 0.0)
            seen += step**2
            weights = np.maximum(0.0, weights - RATE * step / np.sqrt(seen))
            step = sp.sum() + su.sum()
            seen_bias += step**2
            bias -= RATE * step / math.sqrt(seen_bias)
    f, r = unl.take(np.arange(len(unl.size)))
    bias += calibrated(np.bincount(r, weights[f], len(unl.size)) + bias, prior)
    out = np.zeros(BUCKETS)
    out[telling] = weights
    return out, float(bias)


def calibrated(logits: np.ndarray, prior: float) -> float:
    """What to add to logits, given those of unlabelled texts: THRESHOLD goes half the way to the prior's quantile.

    Where fewer unlabelled texts than the prior says score above THRESHOLD, the bias is too low; never the other way.
    """
    now = math.log(THRESHOLD / (1 - THRESHOLD))
    return max(0.0, now - float(np.quantile(logits, 1 - prior))) / 2


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def __call__(self, texts: list) -> list[float]:
        logits = np.array([self.weights[b].sum() for b in bags(texts)]) + self.bias
        return (1 / (1 + np.exp(-np.clip(logits, -60, 60)))).tolist()


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> tuple[np.ndarray, float]:
    """Trains on confirmed toxic documents and on unlabelled ones, which are a sample of the labelled rows outside the
    held-out fold without their labels. Both samples are bounded, so no pass over all ids is needed to draw them.

    The class prior is the share of toxic ones among labelled documents outside that fold.
    """
    known = labels_outside(labels, "toxic", folds, held_out).cache()
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = min(0.9, max(0.001, toxic / n)) if n else 0.01
    positive = texts_of(docs, thinned(known.filter("y = 1"), POSITIVE_ROWS, "toxic"))
    unlabelled = texts_of(docs, thinned(known.withColumn("y", F.lit(0)), UNLABELLED_ROWS, "unlabelled"))
    known.unpersist()
    return train([t for t, _ in positive], [t for t, _ in unlabelled], prior)


def scores(docs: DataFrame, model: tuple[np.ndarray, float], keys: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The keys, score (0 to 1) and predicted, for each document.

    Null and empty texts have no features and get the bias's score. Repeated rows are scored each; an empty table gives
    an empty result; a very long text takes memory in proportion to itself alone. The model, of a fixed size, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = Scorer(*shared.value)
        return lambda texts: (s := score(texts), [int(x >= threshold) for x in s])

    return per_text(docs, "score double, predicted int", make, keys)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
