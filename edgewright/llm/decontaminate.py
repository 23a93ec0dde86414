"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

With 2 for a match and -1 for anything else, an alignment of score 2 t L with
an item of L words has at least t L matched words. So of any L - t L + 1 of the
item's words it matches one: the rarest so many are seeds (n = 1), and no edit,
insertion or order hides a copy from all of them. If at most L / 3 words are
changed, lost or put in between, then t L - L / 6 - 1 matched pairs of words stand
side by side as well, so the rarest pairs are seeds too (n = 2). How often the
corpus has a seed only orders them, so none is too frequent to be sought.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import small, unused, written

#: ASCII punctuation and controls to blanks.
TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
MULTIPLIER = 0x9E3779B97F4A7C15
#: Items are searched in blocks of so many words in all (a few MB in each task), one pass over the corpus for each block.
BLOCK_WORDS = 1_000_000
#: Stretches of a text that are looked at together.
STRETCHES = 32


def words_of(text: bytes | None) -> list[bytes]:
    if text and text.isascii():
        return text.lower().translate(TABLE).split()
    return (text or b"").decode("utf-8", "replace").lower().encode().translate(TABLE).split()


def gram_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key for each window of n word numbers; 0 where one is 0 (unknown)."""
    m = len(ids) - n + 1
    if m < 1:
        return np.empty(0, np.uint64)
    keys, known = np.zeros(m, np.uint64), np.ones(m, bool)
    for i in range(n):
        part = ids[i : i + m]
        keys = keys * np.uint64(MULTIPLIER) + part
        keys ^= keys >> np.uint64(29)
        known &= part > 0
    return np.where(known, keys | np.uint64(1), np.uint64(0))


def align(a: np.ndarray, b: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = 1) -> tuple[int, int]:
    """Best Smith-Waterman score of two rows of word numbers, and where it ends in b.

    A row of the matrix at a time: with gaps of constant cost, the best way in
    from the left is a running maximum.
    """
    row, slope = np.zeros(len(b) + 1, np.int64), gap * np.arange(len(b) + 1)
    best, end = 0, 0
    for x in a:
        up = np.maximum(row - gap, 0)
        up[1:] = np.maximum(up[1:], row[:-1] + np.where(b == x, match, mismatch))
        row = np.maximum.accumulate(up + slope) - slope
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def best_run(matched: np.ndarray) -> int:
    """The greatest sum of a stretch, of 2 for each word that has a match and -1 for each other."""
    total = np.cumsum(np.concatenate(([0], np.where(matched, 2, -1))))
    return int((total - np.minimum.accumulate(total)).max())


class Items:
    """A block of benchmark items, by place in the block: vocabulary, word numbers, pairs of words."""

    def __init__(self, rows: list[tuple[int, bytes]], threshold: float, short: int):
        self.vocab: dict[bytes, int] = {}
        ids = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)], np.uint64) for _, text in rows]
        self.ids, self.sizes = ids, np.array([len(x) for x in ids])
        self.flat, self.starts = np.concatenate(ids).astype(np.int64), np.cumsum(self.sizes) - self.sizes
        #: Items of few words are sought whole.
        self.threshold = np.where(self.sizes < short, 1.0, threshold)
        self.need = np.ceil(self.threshold * self.sizes - 1e-9).astype(np.int64)
        #: An alignment's most words in the text.
        self.reach = np.ceil(self.sizes * (3 - 2 * self.threshold)).astype(np.int64)
        #: The power of two that is no less.
        power = np.ceil(np.log2(self.reach)).astype(np.int64)
        #: A power of two that is no less; items of like reach share one, as fewer looks at a text cost less than wider ones.
        self.steps = 1 << (power.max() - (power.max() - power) // 3 * 3)
        self.pairs = [gram_keys(x, min(2, len(x))) for x in ids]
        self.words = [gram_keys(x, 1) for x in ids]

    def index(self, counts: dict[int, int]) -> None:
        """Seeds: of each item's words and pairs the rarest, as ``counts`` (0 if absent) has them, so many that one is surely shared."""
        keys, items = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]

        def rarest(grams: np.ndarray, shared: int) -> np.ndarray:
            often = np.array([counts.get(k, 0) for k in grams.tolist()])
            return grams[np.lexsort((grams, often))[: len(grams) - shared + 1]]

        for item, (pairs, words, n, t, need) in enumerate(zip(self.pairs, self.words, self.sizes, self.threshold, self.need)):
            seeds = np.unique(np.concatenate((rarest(words, int(need)), rarest(pairs, max(1, int(np.floor(t * n - n / 6 - 1 + 1e-9)))))))
            keys.append(seeds)
            items.append(np.full(len(seeds), item, np.int64))
        keys, items = np.concatenate(keys).astype(np.uint64), np.concatenate(items)
        order = np.argsort(keys, kind="stable")
        self.keys, self.items = keys[order], items[order]
        self.bits = self.bits_of(self.keys)

    @staticmethod
    def bits_of(keys: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << 20, bool)
        bits[keys >> np.uint64(44)] = True
        return bits

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.array(list(map(self.vocab.get, words, repeat(0))), np.uint64)

    def text_keys(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of known words and pairs of words."""
        keys = gram_keys(ids, 2)
        at = np.flatnonzero(keys)
        single = np.flatnonzero(ids)
        return np.concatenate((at, single)), np.concatenate((keys[at], gram_keys(ids[single], 1)))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) of each seed in a text."""
        at, keys = self.text_keys(ids)
        some = self.bits[keys >> np.uint64(44)]
        at, keys = at[some], keys[some]
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        many = high - low
        which = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(at, many), self.items[which]

    def passages(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, words around its seeds) where the text has enough of the item's words.

        The text is looked at in stretches of twice the reach of items of like size, each
        half over the next, so every alignment lies whole in one of them, with a seed.
        """
        at, items = self.hits(ids)
        ids = ids.astype(np.int64)
        for reach in np.unique(self.steps[items]).tolist():
            own = self.steps[items] == reach
            last = max(0, -(-(len(ids) - reach) // reach) - 1)
            first = np.minimum(at[own] // reach, last)
            key = np.concatenate((first * len(self.sizes) + items[own], (np.maximum(first, 1) - 1) * len(self.sizes) + items[own]))
            key = np.unique(key)
            for some in np.split(key, np.searchsorted(key, np.arange(STRETCHES, last + 1, STRETCHES) * len(self.sizes))):
                if len(some):
                    yield from self.enough(ids, reach, last, some // len(self.sizes), some % len(self.sizes))

    def enough(self, ids: np.ndarray, reach: int, last: int, stretch: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Of these stretches (in order, at most STRETCHES different ones) and items the words between the first and last that match, if they can reach the score."""
        low = int(stretch[0])
        there = np.zeros((int(stretch[-1]) - low + 1, len(self.vocab) + 1), bool)
        bounds = [(k * reach, len(ids) if k == last else (k + 2) * reach) for k in range(low, int(stretch[-1]) + 1)]
        for row, (begin, end) in zip(there, bounds):
            row[ids[begin:end]] = True
        sizes = self.sizes[items]
        ends = np.cumsum(sizes)
        words = self.flat[np.repeat(self.starts[items] - (ends - sizes), sizes) + np.arange(ends[-1])]
        present = there[np.repeat(stretch - low, sizes), words]
        kept = np.flatnonzero(np.add.reduceat(present, ends - sizes, dtype=np.int64) >= self.need[items])
        if not len(kept):
            return
        # no alignment scores more than one that may match any word of the other side; here the best runs of all items at once
        side = np.arange(sizes[kept].max())
        row = np.where(side < sizes[kept][:, None], present[np.minimum((ends - sizes)[kept][:, None] + side, len(present) - 1)], False)
        total = np.cumsum(np.where(row, 2, -1), axis=1)
        runs = (total - np.minimum(np.minimum.accumulate(total, axis=1), 0)).max(1)
        mine = np.zeros(len(self.vocab) + 1, bool)
        for i in kept[runs >= 2 * self.threshold[items[kept]] * sizes[kept] - 1e-9].tolist():
            item, (begin, end) = int(items[i]), bounds[int(stretch[i]) - low]
            least = 2 * self.threshold[item] * sizes[i] - 1e-9
            own = self.flat[self.starts[item] : self.starts[item] + sizes[i]]
            mine[own] = True
            matched = mine[ids[begin:end]]
            mine[own] = False
            place, need = np.flatnonzero(matched), int(self.need[item])
            # it has ``need`` matched words among ``reach`` of the text, and ends with matched ones
            if len(place) >= need and (place[need - 1 :] - place[: len(place) - need + 1]).min() < self.reach[item] and best_run(matched) >= least:
                yield item, ids[begin + place[0] : begin + place[-1] + 1]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Items that have a word, by blocks of BLOCK_WORDS words, in order of id."""
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).where("item_id IS NOT NULL AND text IS NOT NULL").dropDuplicates().orderBy("item_id", "text")
    for item, text in rows.toLocalIterator():
        k = len(words_of(bytes(text)))
        if k:
            if block and size + k > BLOCK_WORDS:
                yield block
                block, size = [], 0
            block.append((item, bytes(text)))
            size += k
    if block:
        yield block


def seed_counts(docs: DataFrame, block: Items) -> dict[int, int]:
    """How many documents hold each word and each pair of words of the block; as many rows as the block has of them."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((block.vocab, np.unique(np.concatenate(block.pairs + block.words)), block.sizes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, keys, _ = shared.value
        bits, get, total = Items.bits_of(keys), vocab.get, np.zeros(len(keys), np.int64)
        for batch in batches:
            for text in batch.column(0):
                ids = np.array(list(map(get, words_of(text.as_py()), repeat(0))), np.uint64)
                own = np.unique(np.concatenate((gram_keys(ids, 2), gram_keys(ids[ids > 0], 1))))
                own = own[bits[own >> np.uint64(44)]]
                where = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                total[where[keys[where] == own]] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(total[some])], ["key", "n"])

    found = docs.select(F.col("text").cast("binary")).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    shared.destroy()
    return dict(zip(found["key"].to_numpy(np.int64).view(np.uint64).tolist(), found["n"].tolist()))


def _block_matches(docs: DataFrame, rows: list[tuple[int, bytes]], threshold: float, short: int) -> DataFrame:
    spark = docs.sparkSession
    block = Items(rows, threshold, short)
    block.index(seed_counts(docs, block))
    shared, ids_of = spark.sparkContext.broadcast(block), [x for x, _ in rows]

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                out += [(doc_id, item, passage.astype(np.int32).tobytes()) for item, passage in held.passages(held.numbers(words_of(text.as_py())))]
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()))], ["doc_id", "item", "passage"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(seek, "doc_id long, item int, passage binary")
    found = written(found.withColumn("key", F.sha2("passage", 256)), "passages")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            places, scores = batch.column(1).to_pylist(), []
            for item, passage in zip(places, batch.column(2)):
                ids, words = held.ids[item], np.frombuffer(passage.as_py(), np.int32).astype(np.uint64)
                scores.append(align(ids, words)[0] / (2 * len(ids)))
            arrays = [batch.column(0), batch.column(1), pa.array([ids_of[x] for x in places], pa.int64()), pa.array(scores, pa.float64()), pa.array(held.threshold[places], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "item", "item_id", "score", "least"])

    # equal passages are aligned once, however many documents hold them
    once = found.groupBy("key", "item").agg(F.first("passage").alias("passage")).repartition("key", "item")
    scored = once.mapInArrow(score, "key string, item int, item_id long, score double, least double").where("score >= least - 1e-9")
    out = found.select("doc_id", "key", "item").join(scored, ["key", "item"]).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))
    out = written(out, "matches")
    shared.destroy()
    return out


def matches(docs: DataFrame, items: DataFrame, threshold: float = 0.5, short: int = 5) -> DataFrame:
    """``doc_id, item_id, score`` for each document that holds a copy of an item.

    ``score`` is the alignment's share of the item's own score: 1 for a whole
    copy, less for edited ones; case and ASCII punctuation don't count. Scores
    of ``threshold`` or more are given, for items of fewer than ``short`` words
    whole copies alone. Every passage around a seed (a rare word or pair of words of
    the item) that has enough of the item's words is aligned, however many documents
    hold the seed, so no score of ``threshold`` is missed. Null and empty texts hold nothing,
    items without words aren't sought; repeated rows give one match; null
    doc_ids are matched as one document; an item_id with several texts is
    sought by each. Without items or documents the result is empty.
    """
    out = None
    for rows in _blocks(items):
        part = _block_matches(docs, rows, threshold, short)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double")
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.5, short: int = 5) -> DataFrame:
    """The rows of ``docs`` that hold no item by ``matches``, unchanged.

    Rows with a null doc_id stay; rows that repeat a doc_id share its fate;
    null and empty texts stay. Without items or documents nothing changes.
    """
    key = unused("held", docs)
    held = written(matches(docs, items, threshold, short).where("doc_id IS NOT NULL").select(F.col("doc_id").alias(key)).distinct(), "held")
    return docs.join(small(held), F.col("doc_id").cast("long") == F.col(key), "left_anti")
