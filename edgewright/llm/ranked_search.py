"""Ranked lexical search by a scan of the documents with an Aho-Corasick automaton of all query terms."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import written

TOP = 20
#: Distinct terms of one automaton (some 100 MB in a worker), and terms with repeats of the items that are scored in one scan.
BLOCK_TERMS = 200_000
#: Scores that are held at a time: documents of a batch times items of a block.
HELD = 2_000_000
#: Task results of one item that meet in the first of two rounds.
FAN_IN = 64
NOT_A_TERM = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Every byte that no term has becomes a blank, A-Z lower case; bytes of other characters stay.
FOLDED = bytes.maketrans(NOT_A_TERM + bytes(range(0x41, 0x5B)), b" " * len(NOT_A_TERM) + bytes(range(0x61, 0x7B)))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLDED).split()


def automaton(terms: list[bytes]) -> ahocorasick.Automaton:
    """Finds each term between two blanks, so that no part of a longer term matches; its output is the term's place in the list."""
    found = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        found.add_word(f" {term.decode('latin-1')} ", i)
    found.make_automaton()
    return found


def hits(found: ahocorasick.Automaton, text: bytes | None) -> tuple[int, Counter]:
    """Number of terms of a text, and how often each term of the automaton occurs. Neighbours share the blank between them."""
    words = terms_of(text)
    if not words or not len(found):
        return len(words), Counter()
    return len(words), Counter(map(itemgetter(1), found.iter(f" {b' '.join(words).decode('latin-1')} ")))


def item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """(item_id, {term: repeats}) in blocks of at most BLOCK_TERMS terms; an item with more has a block of its own."""
    texts = items.select(F.col("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    block, size, held, terms = [], 0, None, Counter()

    def full() -> bool:
        return bool(block) and size + len(terms) > BLOCK_TERMS

    # rows come partition by partition, in order of item_id: the driver holds a partition and a block, not all items
    for row in texts.orderBy("item_id").toLocalIterator():
        if held is not None and held[0] == row["item_id"]:
            terms.update(terms_of(row["text"]))
            continue
        if held is not None and terms:
            if full():
                yield block
                block, size = [], 0
            block.append((held[0], terms))
            size += len(terms)
        held, terms = (row["item_id"],), Counter(terms_of(row["text"]))
    if held is not None and terms:
        if full():
            yield block
            block = []
        block.append((held[0], terms))
    if block:
        yield block


def _counts(docs: DataFrame, terms: list[bytes]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents that hold each of ``terms``."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, df, n_docs, n_terms = automaton(shared.value), np.zeros(len(shared.value), np.int64), 0, 0
        for batch in batches:
            for text in batch.column("text"):
                n, tf = hits(found, text.as_py())
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
                df[list(tf)] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *held], pa.int32()), pa.array([n_terms, n_docs, *df[held]], pa.int64())], names=["term", "n"])

    got = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    by_term, df = {r["term"]: r["n"] for r in got}, np.zeros(len(terms), np.int64)
    for term, n in by_term.items():
        if term >= 0:
            df[term] = n
    return by_term.get(-1, 0), by_term.get(-2, 0), df


class Best:
    """The TOP highest scores of each item so far; equal ones by least document, null last."""

    def __init__(self, n_items: int) -> None:
        self.item, self.score, self.doc, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        self.floor = np.ones(n_items, np.int64)

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        d, i = np.nonzero(scores >= self.floor)
        item, score = np.concatenate((self.item, i)), np.concatenate((self.score, scores[d, i]))
        ids, none = np.concatenate((self.doc, doc[d])), np.concatenate((self.null, null[d]))
        order = np.lexsort((ids, none, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < TOP
        self.item, order = item[keep], order[keep]
        self.score, self.doc, self.null = score[order], ids[order], none[order]
        last = place[keep] == TOP - 1
        self.floor[self.item[last]] = self.score[last]


def _best(docs: DataFrame, items: list[tuple], terms: list[bytes], n_docs: int, n_terms: int, df: np.ndarray) -> DataFrame:
    """``item, doc_id, score, task``: the TOP documents of each item within each task."""
    at = {t: i for i, t in enumerate(terms)}
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    # outputs to items: the items of each term, one after another
    listed = sorted((at[t], i, n) for i, (_, own) in enumerate(items) for t, n in own.items())
    of_term, of_item, repeats = (np.array(x, np.int64) for x in zip(*listed, strict=True))
    begins = np.searchsorted(of_term, np.arange(len(terms) + 1))
    shared = docs.sparkSession.sparkContext.broadcast((terms, weight, of_item, repeats, begins))
    n_items, rows = len(items), max(1, HELD // max(1, len(items)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, of_item, repeats, begins = shared.value
        found, best = automaton(terms), Best(n_items)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                scores = np.zeros((part.num_rows, n_items), np.int64)
                for k, text in enumerate(part.column("text")):
                    n, counts = hits(found, text.as_py())
                    if not counts:
                        continue
                    term, tf = np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
                    m = 100 - 25 + (25 * n * n_docs) // n_terms
                    value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
                    size = begins[term + 1] - begins[term]
                    place = np.repeat(begins[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    np.add.at(scores[k], of_item[place], np.repeat(value, size) * repeats[place])
                ids = part.column("doc_id")
                best.add(scores, np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()))
        columns = [pa.array(best.item, pa.int32()), pa.array(best.doc, pa.int64(), mask=best.null), pa.array(best.score, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return docs.mapInArrow(scan, "item int, doc_id long, score long").withColumn("task", F.spark_partition_id())


def ranked(docs: DataFrame, items: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """``item_id, rank, doc_id, score``: the TOP highest-scoring documents above 0 of each item.

    Two scans of the documents for each block of items: one counts in how
    many documents each term is, one scores. Nothing of a document outlives its batch but the
    best of each item and task. Null and empty texts have no terms. Rows with
    one item_id, null included, are one item with the terms of its different
    texts; an item without terms has no rows. Each row of ``docs`` is a
    document, repeated ids and all; among equal scores a null doc_id comes
    last. Empty tables give an empty one.
    """
    spark = spark or docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in item_blocks(items):
        terms = sorted({t for _, own in block for t in own})
        n_docs, n_terms, df = _counts(texts, terms)
        if not n_terms:
            break
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        task = written(_best(texts, block, terms, n_docs, n_terms, df), "best")
        # a few tasks' results first, so that no item gathers those of all tasks at once
        few = F.row_number().over(W.partitionBy("item", F.floor(F.col("task") / FAN_IN)).orderBy(*order))
        rank = F.row_number().over(W.partitionBy("item").orderBy(*order))
        top = task.withColumn("rank", few).where(F.col("rank") <= TOP).withColumn("rank", rank).where(F.col("rank") <= TOP)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item int, item_id {kind}")
        out = out.unionByName(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # a block has at most BLOCK_TERMS items
    return out


RANKED_SQL = r"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
wanted AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
repeats AS (SELECT item_id, term, count(*) AS r FROM wanted GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY 1),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM repeats) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY 1), totals),
scores AS (SELECT item_id, doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
           FROM tfs JOIN weights USING (term) JOIN repeats USING (term) JOIN lengths USING (doc_id), totals GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20"""
