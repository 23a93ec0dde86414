"""Vector codes and ranked search against brute force, toxicity on held-out documents."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from edgewright.llm import ranked_search, toxicity, vector_codes

DOCS = "doc_id long, text string, TEXT_ string"


# vector codes


def brute_codes(rows):
    kept = sorted(((i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4)
    kept = [(i, v + [0] * (4 * width - len(v)), label) for i, v, label in kept]
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:256]] for p in range(4)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            mine = {}
            for _, v, _ in kept:
                mine.setdefault(near(part(v, p), books[p])[1], []).append(part(v, p))
            for k, xs in mine.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, by_label = [], Counter()
    for i, v, label in kept:
        found = [near(part(v, p), books[p]) for p in range(4)]
        error = sum(d for d, _ in found)
        by_label[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((repr(i), code, error, by_label[label], sha) for i, code, error, label in out)


def codes(spark, rows, schema="vec_id long, embedding array<float>, label int, of string"):
    df = spark.createDataFrame([(*r, "x") for r in rows], schema)
    return sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.coded(df).collect())


@pytest.mark.parametrize("n,dim", [(300, 8), (40, 12), (30, 4)])
def test_codes_equal_brute_force(spark, n, dim):
    rng = np.random.default_rng(n)
    # few different components give ties
    rows = [(i, [float(x) for x in rng.integers(-3, 4, dim) / 1024 + 0.3 * (i % 3)], i % 4 if i % 5 else None) for i in range(n)]
    assert codes(spark, rows) == brute_codes([(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows])


def test_codes_of_odd_vectors(spark):
    rows = [(1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf")], None), (5, [0.5, -0.25, 1.0], None), (5, [0.5, -0.25, 1.0], None), (None, [], 2), (6, [-1.0, 0.25, 0.5, 2.0, 1.0], 2)]
    assert codes(spark, rows) == brute_codes(rows)
    assert codes(spark, []) == []
    assert codes(spark, [(1, None, 1)]) == []
    assert [r[1:4] for r in codes(spark, [(1, [], 1)])] == [("00000000", 0, 0)]
    most = vector_codes.largest(1)
    huge = codes(spark, [(1, [3e38, 0.0, 0.0, 0.0], 1), (2, [-3e38, 0.0, 0.0, 0.0], 1)])
    assert [r[2] for r in huge] == [0, 0] and most == 2**29


def test_coefficients_keep_distances_and_come_by_sequency():
    h = vector_codes.transformed(np.eye(16, dtype=np.int64))
    assert [(np.diff(h[:, k]) != 0).sum() for k in range(16)] == list(range(16))
    rng = np.random.default_rng(1)
    x, y = rng.integers(-(2**25), 2**25, (2, 50, 13))
    d = vector_codes.transformed(x) - vector_codes.transformed(y)
    assert ((d * d).sum(1) == 16 * ((x - y) ** 2).sum(1)).all()


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, top=20):
    found = [(i, Counter(brute_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    wanted = {}
    for item, text in set(items):
        wanted.setdefault(item, Counter()).update(brute_terms(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, c in found:
            if c:
                m = 100 - 25 + 25 * c.total() * n_docs // n_terms
                s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, r in terms.items() if c[t])
                if s > 0:
                    scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def search(spark, docs, items):
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item_id string").repartition(5)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    return sorted((tuple(r) for r in ranked_search.ranked(d, i).collect()), key=repr)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = ["a", "ab", "abc", "B", "Bc", "é", "Éa", " x", "日本", "a_b", "x\x00y", "1a", "q"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", "\n", "  ", "é", "\x7f"]) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 30))) for i in range(120)] + [(7, "a ab"), (7, "a ab"), (None, "abc abc"), (900, None), (901, ""), (902, " -- "), (903, "a " * 20_000)]
    items = [(k, text(rng.randrange(1, 12))) for k in range(15)] + [(3, "abc q"), (3, "abc q"), (None, "ab"), (50, None), (51, "..."), (52, "nowhere")]
    want = brute_search(docs, items)
    assert search(spark, docs, items) == want
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 10)
    monkeypatch.setattr(ranked_search, "HELD", 30)
    monkeypatch.setattr(ranked_search, "FAN_IN", 2)
    assert search(spark, docs, items) == want


def test_search_of_empty_tables(spark):
    assert search(spark, [], [(1, "a")]) == []
    assert search(spark, [(1, "a")], []) == []
    assert search(spark, [(1, None)], [(1, "a")]) == []


def test_neighbours_share_a_boundary():
    found = ranked_search.automaton([b"a", b"aa"])
    assert ranked_search.hits(found, b"a a aa A,a") == (5, Counter({0: 4, 1: 1}))


# toxicity


def toxic_corpus(n, seed=5):
    rng = random.Random(seed)
    syllables = ["ba", "ko", "ri", "tel", "mu", "san", "ve", "do", "lin", "pa"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5)))
    docs, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randrange(20, 120))], rng.random() < 0.12
        if toxic:
            bad = (lambda: rng.choice(["jerkface", "Zounds", "WRETCH"])) if i % 2 else (lambda: "grmbl" + word())
            for _ in range(rng.randrange(2, 6)):
                words[rng.randrange(len(words))] = bad()
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_toxic_documents_of_the_held_out_fold(spark):
    docs, labels = toxic_corpus(1500)
    # labels of the held-out fold are turned round: no score may know them
    given = [(i, 1 - t if held(i) else t) for i, t in labels]
    d = spark.createDataFrame([(*x, "t") for x in docs + [(None, None), (9000, ""), (9001, "zounds " * 50_000), (5, docs[5][1])]], DOCS)
    marks = spark.createDataFrame(given + given[:9] + [(None, 1), (77777, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.scored(d, marks).collect()
    assert len(rows) == 1504 and toxicity.scored(d, marks).columns == ["doc_id", "held_out", "score", "predicted"]
    by_id = {r["doc_id"]: r for r in rows}
    assert all(r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"])) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    assert by_id[None]["score"] == by_id[9000]["score"] < 0.3 and by_id[9001]["predicted"] == 1
    for toxic in (0, 1):
        right = [by_id[i]["predicted"] == t for i, t in labels if held(i) and t == toxic]
        assert sum(right) / len(right) > 0.95


def test_toxicity_without_examples(spark):
    docs = spark.createDataFrame([(1, "a b c", ""), (None, None, "")], DOCS)
    for marks in ([], [(1, 0)], [(1, 1)], [(1, None)]):
        assert {(r["score"], r["predicted"]) for r in toxicity.scored(docs, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()} == {(0.0, 0)}
    assert toxicity.scored(docs.where("false"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_label_model_knows_correlated_votes():
    rng = np.random.default_rng(2)
    n = 4000
    y = rng.random(n) < 0.2
    a, b = (rng.random(n) < np.where(y, 0.7, 0.05) for _ in range(2))
    # the third voter repeats the first, so it adds nothing
    votes = np.column_stack((a, a, b)).astype(bool)
    known = np.where(np.arange(n) < 1000, y, -1).astype(int)
    model = toxicity.label_model(votes, known, np.ones(n))
    got = {k: model.posterior(np.array([k], bool))[0] for k in ((1, 1, 0), (1, 1, 1), (0, 0, 1))}
    truth = {k: y[(votes == k).all(1)].mean() for k in got}
    assert abs(got[1, 1, 0] - truth[1, 1, 0]) < 0.15 and got[1, 1, 1] > 0.9
    # withheld votes don't count against a class, so the share of toxic texts comes out a little high
    assert 0.17 < model.prior < 0.25
