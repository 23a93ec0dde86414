"""Quality classifier learned from positives and unlabelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import hash63, hash_bound, text_batches

UPPER, DIGITS, SYMBOLS, BLANKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b" \t\n\r\x0b\x0c"
PUNCTUATION = b".,;:!?'\"()-"
N_FEATURES = 13


def features(text: bytes | None) -> list[float]:
    """Shape of a UTF-8 text; null counts as empty, which has zeros only."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    chars = len(text.translate(None, BLANKS))
    share = lambda of: (len(text) - len(text.translate(None, of))) / chars
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        np.log1p(n),
        min(chars / n, 40.0),
        np.sqrt(share(SYMBOLS)),
        np.sqrt(share(UPPER)),
        np.sqrt(share(DIGITS)),
        np.sqrt(share(PUNCTUATION)),
        np.sqrt(text.count(b"!") / n),
        np.sqrt(text.count(b"|") / n),
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        1.0,
    ]


@dataclass(frozen=True)
class Model:
    """A network of one hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 12, steps: int = 600, rate: float = 0.02, seed: int = 7) -> Model:
    """Minimise the non-negative unbiased risk with the logistic loss.

    risk = prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]). Where
    the second part, the risk on negatives, falls below zero, the step goes
    back up that part only, which keeps the network from fitting the positives
    among the unlabelled as negatives.
    """
    both = np.concatenate((positive, unlabelled))
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    rng = np.random.default_rng(seed)
    theta = [rng.normal(0, 0.4, (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.4, hidden), np.zeros(1)]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        hp, hu = np.tanh(p @ theta[0] + theta[1]), np.tanh(u @ theta[0] + theta[1])
        zp, zu = hp @ theta[2] + theta[3], hu @ theta[2] + theta[3]
        below = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() < 0
        # derivatives by g of the two parts of the risk
        gp_pos, gp_neg, gu = -prior * (1 - sigmoid(zp)) / len(p), -prior * sigmoid(zp) / len(p), sigmoid(zu) / len(u)
        gp, gu = (-gp_neg, -gu) if below else (gp_pos + gp_neg, gu)
        dp, du = np.outer(gp, theta[2]) * (1 - hp**2), np.outer(gu, theta[2]) * (1 - hu**2)
        grads = [p.T @ dp + u.T @ du, dp.sum(0) + du.sum(0), hp.T @ gp + hu.T @ gu, np.array([gp.sum() + gu.sum()])]
        for i, g in enumerate(grads):
            g = g + 1e-4 * theta[i] * (i in (0, 2))
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            theta[i] = theta[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, theta[0], theta[1], theta[2], float(theta[3][0]))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 5000, max_unlabelled: int = 10000) -> Model | None:
    """Learn from at most ``max_positive`` trusted positives and ``max_unlabelled`` other texts.

    Only documents outside fold 0 count. Positives are the labelled rows with
    quality 1; unlabelled text is a hash sample of all documents, whatever
    their label. The class prior is the share of quality 1 in the labels
    (smoothed). Repeated label rows count once, with the larger label; null
    labels, ids and rows without a document don't count. None without positives.
    """
    marks = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where((fold(F.col("doc_id")) != 0) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, ones = marks.agg(F.count("*"), F.sum("quality")).first()
    n_docs = docs.count()
    if not ones or not n_docs:
        return None
    prior = min(0.98, (ones + 1) / (n + 2))
    by_hash = hash63("doc_id", 11)
    trusted = marks.where("quality = 1").orderBy(by_hash, "doc_id").limit(max_positive).select("doc_id", F.lit(True).alias("trusted"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).where(fold(F.col("doc_id")) != 0)
    found = texts.join(F.broadcast(trusted), "doc_id", "left").withColumn("h", by_hash).withColumn("u", F.col("h") <= hash_bound(max_unlabelled, n_docs)).where("trusted OR u")

    @F.pandas_udf("array<double>")
    def measure(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in s:
            yield x.map(features)

    rows = found.select("h", "doc_id", "trusted", "u", measure("text").alias("x")).limit(2 * max_positive + 2 * max_unlabelled + 200).collect()
    rows.sort(key=lambda r: (r["h"], r["doc_id"], r["x"]))
    positive = np.array([r["x"] for r in rows if r["trusted"]])[:max_positive]
    unlabelled = np.array([r["x"] for r in rows if r["u"]])[:max_unlabelled]
    if len(positive) and not len(unlabelled):
        raise RuntimeError("no unlabelled text in the sample")
    return fit_nnpu(positive, unlabelled, prior) if len(positive) else None


def score_column(model: Model | None, text: Column) -> Column:
    """Score of each text, 0 to 1; 1 for all without a model."""
    if model is None:
        return F.lit(1.0)

    @F.pandas_udf("double")
    def score(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in s:
            yield pd.Series(model.score(np.array([features(t) for t in x]).reshape(-1, N_FEATURES)))

    return score(text.cast("binary"))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Null texts score as empty ones; a null doc_id is not held out. Equal texts
    have equal scores. Without usable labels every score is 1.
    """
    score = score_column(train(docs, labels), F.col("text"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score reaches ``threshold``."""
    text_batches(docs.sparkSession)
    score = score_column(train(docs, labels), F.col("text"))
    return docs.where(score >= threshold)
