"""Samples that hold at any number of documents, and benchmark copies that no pair of words betrays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgewright.llm import decontaminate, quality_model, quality_rules, queries, token_store, work

SCHEMA = "doc_id long, text string, lang string"


@pytest.mark.parametrize("of", [0, 1, 10, 10_000, 10**9, 2 * 10**10, 10**11, 10**15])
def test_share_of_a_sample_never_reaches_zero(of):
    bound = work.hash_bound(12_000, of)
    assert min(of, 12_000) <= of * (bound + 1) / 2**63 + 1 <= max(1.2 * 12_000 + 102, 0) + 1 or of <= 14_500 and bound == 2**63 - 1


def test_sample_of_rows_is_as_large_as_asked(spark):
    ids = spark.range(200_000).withColumnRenamed("id", "doc_id")
    n = ids.where(work.hash63("doc_id", 3) <= work.hash_bound(5000, 200_000)).count()
    assert 5800 < n < 6400


def _docs(spark):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(80))
    return spark.createDataFrame([(i, text(), "en") for i in range(300)], SCHEMA)


def test_far_too_large_counts_raise_and_never_score_all_alike(spark, monkeypatch):
    docs, labels = _docs(spark), spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    assert quality_model.train(docs, labels) is not None
    monkeypatch.setattr(type(docs), "count", lambda self: 10**15)
    with pytest.raises(RuntimeError, match="no unlabelled"):
        quality_model.train(docs, labels)


def test_rules_are_ordered_by_a_sample_of_any_corpus(spark, monkeypatch):
    seen = []
    real = work.hash_bound
    monkeypatch.setattr(quality_rules, "hash_bound", lambda rows, of: seen.append(real(rows, 10**11)) or real(rows, of))
    assert sorted(quality_rules.order_rules(_docs(spark))) == sorted(quality_rules.RULES) and seen[0] > 10**11


def _all_pairs(texts, items, threshold=0.5):
    vocab, out = {}, {}
    number = lambda t: np.array([vocab.setdefault(w, len(vocab) + 1) for w in decontaminate.words_of(t.encode())], np.uint64)
    numbered = [(i, number(t)) for i, t in items]
    for d, t in enumerate(texts):
        words = number(t)
        for i, ids in numbered:
            score = decontaminate.align(ids, words)[0] / (2 * len(ids))
            if score >= threshold - 1e-9:
                out[d, i] = score
    return out


def test_copies_with_words_put_in_everywhere_are_found(spark):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(15)]
    vocab = [f"w{i}" for i in range(400)]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else rng.choice(vocab)
    items = [(i, " ".join(word() for _ in range(rng.choice([6, 12, 40, 41, 60])))) for i in range(20)]
    texts = []
    for _, t in items:
        own = t.split()
        apart = [x for w in own for x in (w, "filler")]
        texts.append(" ".join(word() for _ in range(60)) + " " + " ".join(apart) + " " + " ".join(word() for _ in range(60)))
        texts.append(" ".join(own[::2] + own[1::2]))  # no pair of neighbours is left
        half = len(own) // 2
        texts.append(" ".join(own[half:] + own[:half]))
        texts.append(" ".join(w if rng.random() < 0.75 else word() for w in own))
        texts.append(" ".join(x for w in own for x in ([w] if rng.random() < 0.8 else [w, word()])))
        texts.append(" ".join(w for w in own if rng.random() < 0.75))
        texts.append(" ".join(y for k, w in enumerate(own) for y in ([w, "one", "two"] if k % 4 == 3 else [w])))
    texts.append(" ".join(word() for _ in range(6000)) + " " + " ".join(x for w in items[3][1].split() for x in (w, "filler")) + " " + " ".join(word() for _ in range(6000)))
    want = _all_pairs(texts, items)
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.matches(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 60
    assert any(0.5 <= s <= 0.52 for s in want.values())


def test_label_rows_of_no_document_do_not_count(spark):
    docs = _docs(spark)
    assert quality_model.train(docs, spark.createDataFrame([(10**7, 1)], "doc_id long, quality int")) is None
    scores = quality_model.scored(docs, spark.createDataFrame([], "doc_id long, quality int")).agg(F.min("score"), F.max("score")).first()
    assert tuple(scores) == (1.0, 1.0)


def test_an_encoder_forgets_pieces_before_they_fill_a_worker():
    """Workers live from task to task: two of them and the heap share an executor."""
    encoder = token_store.Encoder(queries.tokenizer_path())
    for first in range(0, 1_300_000, 50_000):
        encoder.batch([" ".join(map(str, range(first, first + 50_000)))])
    assert len(encoder.known) < 1_100_000
