"""Toxicity by weak supervision: voters found in labelled texts, a generative label model, a linear classifier."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import hash63, hash_bound, small, text_batches, written

WORD = r"[\p{L}\p{M}]+"
#: Lengths of beginnings and ends of words that can be patterns.
LENGTHS = range(3, 9)
#: A voter speaks up from this many hits of its pattern on.
LEVELS = (1, 2, 3, 5)
MAX_PATTERNS, MAX_VOTERS, MIN_SUPPORT = 400, 80, 4
#: Least information of a voter, in nats over the toxic texts: less is likely chance among so many patterns.
MIN_GAIN = 6.0
#: Known words whose patterns a task remembers.
MEMORY = 200_000

_words = regex.compile(WORD)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def hits(text: str | None, places: dict[str, int], memory: dict[str, tuple]) -> Counter:
    """How often each pattern occurs in a text.

    A pattern is ``=word`` (a whole word), ``<begin`` or ``>end``.
    """
    words = Counter(_words.findall((text or "").lower()))
    out: Counter = Counter()
    for word, n in words.items():
        found = memory.get(word)
        if found is None:
            pieces = [f"={word}", *(f"<{word[:k]}" for k in LENGTHS if k <= len(word)), *(f">{word[-k:]}" for k in LENGTHS if k <= len(word))]
            found = tuple(places[p] for p in pieces if p in places)
            if len(memory) < MEMORY:
                memory[word] = found
        for i in found:
            out[i] += n
    return out


@dataclass(frozen=True)
class Model:
    """A linear classifier; each input tells whether a pattern has so many hits or more."""

    patterns: list[str]
    columns: list[tuple[int, int]]
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None], memory: dict[str, tuple]) -> np.ndarray:
        places = {p: i for i, p in enumerate(self.patterns)}
        steps = np.zeros((len(self.patterns), max(LEVELS) + 1))
        for (i, level), w in zip(self.columns, self.weights, strict=True):
            steps[i, level:] += w
        out = np.array([self.bias + sum(steps[i, min(n, max(LEVELS))] for i, n in hits(t, places, memory).items()) for t in texts])
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


@dataclass
class LabelModel:
    """Joint distribution of a hidden class and votes that are either spoken or withheld.

    Votes form a tree: how likely a voter speaks up depends on the class (its
    accuracy) and on what the voter above it said (their correlation). A
    withheld vote counts only where the voter above spoke, since most voters
    know one language only; the silence of all is a vote of its own.
    ``spoke[said, y, j]``: voter j speaks up in class y where the one above said so.
    """

    prior: float
    parent: np.ndarray
    spoke: np.ndarray
    silence: np.ndarray

    @classmethod
    def of(cls, votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> LabelModel:
        """Of the largest likelihood for class probabilities ``toxic`` of weighted rows, counts smoothed."""
        n, k = weight.sum(), votes.shape[1]
        v, quiet = votes.astype(float), ~votes.any(1)
        info, alone, both, silence = np.zeros((k, k)), np.zeros((2, k)), np.zeros((2, k, k)), np.zeros(2)
        for y, w in enumerate((weight * (1 - toxic), weight * toxic)):
            alone[y], both[y] = v.T @ w, v.T @ (v * w[:, None])
            silence[y] = (w[quiet].sum() + 1) / (w.sum() + 2)
            total = w.sum() + 2
            one, two = (alone[y] + 1) / total, (both[y] + 0.5) / total
            first, second = one[:, None], one[None]
            for joint, free in ((two, first * second), (first - two, first * (1 - second)), (second - two, (1 - first) * second), (1 - first - second + two, (1 - first) * (1 - second))):
                joint = np.clip(joint, 1e-9, 1)
                info += total / n * joint * np.log(joint / free)
            alone[y] = (alone[y] + 0.5) / (w.sum() + 1)
        # the tree of largest information between votes of one class, grown from the first voter
        parent, best, link = np.full(k, -1), np.full(k, -np.inf), np.full(k, -1)
        left, at = set(range(1, k)), 0
        while left:
            for j in left:
                if info[at, j] > best[j]:
                    best[j], link[j] = info[at, j], at
            at = max(left, key=lambda j: best[j])
            parent[at] = link[at]
            left.remove(at)
        up, each, spoke = np.maximum(parent, 0), np.arange(k), np.zeros((2, 2, k))
        for y, w in enumerate((weight * (1 - toxic), weight * toxic)):
            # few cases lean on the voter's rate in the class
            above = np.where(parent >= 0, alone[y][up] * (w.sum() + 1) - 0.5, 0)
            together = np.where(parent >= 0, both[y][each, up], 0)
            mine = alone[y] * (w.sum() + 1) - 0.5
            spoke[1, y] = (together + 2 * alone[y]) / (above + 2)
            spoke[0, y] = (mine - together + 2 * alone[y]) / (w.sum() - above + 2)
        return cls(float(((weight * toxic).sum() + 1) / (n + 2)), parent, np.clip(spoke, 1e-6, 1 - 1e-6), silence)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        said = votes[:, np.maximum(self.parent, 0)] & (self.parent[None] >= 0)
        gain, loss = np.log(self.spoke[:, 1] / self.spoke[:, 0]), np.log((1 - self.spoke[1, 1]) / (1 - self.spoke[1, 0]))
        z = np.where(votes, np.where(said, gain[1], gain[0]), np.where(said, loss, 0)).sum(1)
        z = z + np.log(self.prior) - np.log1p(-self.prior) + np.where(votes.any(1), 0, np.log(self.silence[1]) - np.log(self.silence[0]))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def label_model(votes: np.ndarray, known: np.ndarray, weight: np.ndarray, rounds: int = 15) -> LabelModel:
    """Expectation-maximisation: ``known`` is 0 or 1 for labelled rows, else -1; those start from a model of the labelled ones alone."""
    sure = known >= 0
    model = LabelModel.of(votes[sure], known[sure].astype(float), weight[sure])
    for _ in range(rounds if (~sure).any() else 0):
        model = LabelModel.of(votes, np.where(sure, known, model.posterior(votes)), weight)
    return model


def columns_of(counts: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
    """(pattern, level) that MIN_SUPPORT labelled toxic texts or more reach; of those that agree everywhere the first."""
    found, seen = [], set()
    for i in range(counts.shape[1]):
        for level in LEVELS:
            vote = counts[:, i] >= level
            key = np.packbits(vote).tobytes()
            if vote[known == 1].sum() >= MIN_SUPPORT and key not in seen:
                seen.add(key)
                found.append((i, level))
    return found


def chosen_voters(votes: np.ndarray, columns: list[tuple[int, int]], known: np.ndarray) -> list[int]:
    """Places of at most MAX_VOTERS columns, each of the largest information on labels once toxic texts of earlier ones count half.

    A column whose votes are mostly (four fifths) among those of another chosen pattern is left out: it only counts that pattern's hits again.
    """
    toxic, clean = votes[known == 1].astype(float), votes[known == 0].mean(0)
    b, weight, found = (clean * (known == 0).sum() + 0.5) / ((known == 0).sum() + 1), np.ones(len(toxic)), []
    pattern, size, open_ = np.array([i for i, _ in columns]), votes.sum(0), np.ones(len(columns), bool)
    while len(found) < MAX_VOTERS and open_.any():
        a = (weight @ toxic + 0.5) / (weight.sum() + 1)
        gain = np.where(open_ & (a > b), a * np.log(a / b) + (1 - a) * np.log((1 - a) / (1 - b)), -1)
        best = int(gain.argmax())
        if gain[best] * weight.sum() < MIN_GAIN:
            break
        found.append(best)
        open_[best] = False
        open_ &= (pattern == pattern[best]) | (votes[votes[:, best]].sum(0) < 0.8 * size)
        weight = np.where(toxic[:, best] > 0, weight / 2, weight)
    return sorted(found)


def fit_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray, penalty: float = 0.1, steps: int = 500) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; the penalty is on squared weights."""
    x1 = np.column_stack((x, np.ones(len(x)))).astype(np.float32)
    shrink = np.append(np.full(x.shape[1], penalty), 1e-6).astype(np.float32)
    # the largest curvature bounds the step
    u = np.ones(x1.shape[1], np.float32)
    for _ in range(30):
        u = x1.T @ (weight * (x1 @ u)).astype(np.float32) / 4
        u, size = u / np.linalg.norm(u), np.linalg.norm(u)
    step, w, old, t = 1 / (1.05 * size + penalty), np.zeros_like(u), np.zeros_like(u), 1.0
    for _ in range(steps):
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = (w + (t - 1) / nxt * (w - old)).astype(np.float32)
        p = 1 / (1 + np.exp(-np.clip(x1 @ y, -40, 40)))
        old, w, t = w, y - step * (x1.T @ (weight * (p - target)).astype(np.float32) + shrink * y), nxt
    return w[:-1].astype(float), float(w[-1])


def weights_of(known: np.ndarray, share: float) -> np.ndarray:
    """1 for each row, but labelled rows so that toxic ones have their share among all labels, whatever the sample's bounds."""
    toxic, clean = (known == 1).sum(), (known == 0).sum()
    each = {1: share * (toxic + clean) / max(1, toxic), 0: (1 - share) * (toxic + clean) / max(1, clean)}
    return np.where(known == 1, each[1], np.where(known == 0, each[0], 1.0))


def sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int, max_unlabelled: int) -> tuple[DataFrame, float] | None:
    """``doc_id, text, toxic`` (-1: not labelled) of at most so many documents of the training folds, by hash order, and the share of toxic ones among all labelled; None without both labels."""
    learn = fold(F.col("doc_id")) != 1
    marks = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).where(learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(learn)
    known = written(marks.join(ids.distinct(), "doc_id", "left_semi"), "toxic_labels")
    part = lambda value, most: known.where(F.col("toxic") == value).orderBy(hash63("doc_id", 5), "doc_id").limit(most)
    n_docs = ids.count()
    some = ids.where(hash63("doc_id", 6) <= hash_bound(max_unlabelled, n_docs)).distinct()
    others = some.join(known, "doc_id", "left_anti").orderBy(hash63("doc_id", 6), "doc_id").limit(max_unlabelled)
    picked = written(part(1, max_toxic).unionByName(part(0, max_clean)).unionByName(others.select("doc_id", F.lit(-1).alias("toxic"))), "toxic_sample")
    n, n_toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not n_toxic or n_toxic == n:
        return None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(picked), "doc_id")
    # one text for each id, wherever its rows lie
    return written(texts.groupBy("doc_id", "toxic").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")), "toxic_texts"), n_toxic / n


def mined_patterns(texts: DataFrame) -> list[str]:
    """At most MAX_PATTERNS words, beginnings and ends that labelled toxic texts have and clean ones lack.

    Copies of a text count once: of texts with one least hash of their runs of three words, only the first does.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    known = texts.where("toxic >= 0").withColumn("words", words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 2, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("words", i, 3), " ")))
    first = known.groupBy("toxic", F.array_min(runs).alias("run")).agg(F.min_by("words", "doc_id").alias("words"))
    n = {r["toxic"]: r["count"] for r in first.groupBy("toxic").count().collect()}
    by_word = first.select("toxic", F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    size = F.length("w")
    pieces = [F.when(size >= k, F.concat(F.lit("<"), F.substring("w", 1, k))) for k in LENGTHS] + [F.when(size >= k, F.concat(F.lit(">"), F.right("w", F.lit(k)))) for k in LENGTHS]
    each = by_word.select("t", "c", F.explode(F.array(F.concat(F.lit("="), F.col("w")), *pieces)).alias("pattern")).where("pattern IS NOT NULL")
    counts = each.groupBy("pattern").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(F.col("t") >= MIN_SUPPORT)
    odds = F.ln((F.col("t") + 0.5) / (n[1] + 1)) - F.ln((F.col("c") + 0.5) / (n[0] + 1))
    strength = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    best = counts.where(odds > 1).orderBy(F.desc(F.round(strength, 9)), "pattern").limit(MAX_PATTERNS)
    return [r["pattern"] for r in best.select("pattern").collect()]


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 2000, max_clean: int = 4000, max_unlabelled: int = 6000) -> Model | None:
    """Learn from at most ``max_toxic`` and ``max_clean`` labelled documents and ``max_unlabelled`` others, all of folds 0 and 2.

    Label rows repeated for a document count once, as toxic if one says so;
    null labels and labels without a document don't count. None where toxic or
    clean examples, or patterns that tell them apart, are missing.
    """
    found = sample(docs, labels, max_toxic, max_clean, max_unlabelled)
    if found is None:
        return None
    texts, share = found
    patterns = mined_patterns(texts)
    if not patterns:
        return None
    places = {p: i for i, p in enumerate(patterns)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, tuple] = {}
        for batch in batches:
            found = [hits(t, places, memory) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), batch.column("toxic")]
            columns += [pa.array([list(f(c)) for c in found], pa.list_(pa.int32())) for f in (Counter.keys, Counter.values)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "pattern", "times"])

    rows = sorted(texts.mapInArrow(count, "doc_id long, toxic int, pattern array<int>, times array<int>").collect())
    known, counts = np.array([r["toxic"] for r in rows]), np.zeros((len(rows), len(patterns)), np.int32)
    for k, r in enumerate(rows):
        counts[k, r["pattern"]] = r["times"]
    columns = columns_of(counts, known)
    if not columns:
        return None
    x = np.column_stack([counts[:, i] >= level for i, level in columns])
    votes = x[:, chosen_voters(x, columns, known)]
    if not votes.shape[1]:
        return None
    weight = weights_of(known, share)
    weights, bias = fit_linear(x, label_model(votes, known, weight).posterior(votes), weight)
    return Model(patterns, columns, weights, bias)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Null texts score as empty ones; a null doc_id is not held out; rows may
    repeat. Equal texts have equal scores. Without a model every score is 0.
    """
    text_batches(docs.sparkSession)
    model = train(docs, labels)
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, tuple] = {}
        for batch in batches:
            s = model.score(batch.column("text").to_pylist(), memory)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    out = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
