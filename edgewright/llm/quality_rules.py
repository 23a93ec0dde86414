"""Quality rules as a short-circuit cascade."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import hash63, hash_bound

BLANKS, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
FOLLOW = bytes(range(0x80, 0xC0))  # bytes that don't begin a code point
UPPER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"


@dataclass
class Text:
    """A text and the counts that rules share."""

    raw: bytes
    words: list[bytes] = field(init=False)

    def __post_init__(self) -> None:
        self.words = self.raw.split()
        self.n_words = len(self.words)
        self.word_chars = len(self.raw.translate(None, BLANKS + FOLLOW))
        self.n_symbols = self.count(SYMBOLS)
        lines = [x for x in self.raw.split(b"\n") if x.strip()]
        self.n_lines = len(lines)
        self.n_dup_lines = len(lines) - len(set(lines))
        self.n_repeat_words = repeat_words(self.words)

    def count(self, of: bytes) -> int:
        return len(self.raw) - len(self.raw.translate(None, of))


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words covered by windows of ``size`` words that occur twice or more."""
    windows = list(zip(*(words[i:] for i in range(size))))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    hit = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for i in range(size):
        covered[i : i + len(hit)] |= hit
    return int(covered.sum())


def base_failed(t: Text) -> bool:
    return t.n_words < 50 or 100 * t.n_repeat_words > 50 * t.n_words


#: Each rule says whether it rejects; all must pass, so their order changes cost alone.
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "repeated_lines": lambda t: 10 * t.n_dup_lines > 3 * t.n_lines,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words,
    "shouting": lambda t: 2 * t.count(UPPER) > t.word_chars,
    "digits": lambda t: 3 * t.count(DIGITS) > t.word_chars,
}


def order_rules(docs: DataFrame, sample: int = 2000, rules: dict[str, Callable[[Text], bool]] | None = None) -> list[str]:
    """Rule names by rejections per second, best first, as measured on about ``sample`` hashed rows.

    Each place goes to the rule that rejects most per second of what the rules
    before it leave. A row's rejections go to the driver as one number, whose
    bits are the rules, with its count.
    """
    rules = rules or RULES
    part = docs.where(hash63("doc_id", 5) <= hash_bound(sample, docs.count()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, masks = Counter(), Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                t = Text(x or b"")
                if base_failed(t):
                    continue
                mask = 0
                for i, (name, rejects) in enumerate(rules.items()):
                    began = time.perf_counter()
                    mask |= bool(rejects(t)) << i
                    spent[name] += time.perf_counter() - began
                masks[mask] += 1
        rows = [("", k, float(v)) for k, v in masks.items()] + [(name, 0, spent[name]) for name in rules]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.float64()))], ["rule", "mask", "amount"])

    found = part.select(F.col("text").cast("binary")).mapInArrow(measure, "rule string, mask long, amount double").groupBy("rule", "mask").agg(F.sum("amount").alias("amount")).collect()
    left = {r["mask"]: r["amount"] for r in found if not r["rule"]}
    seconds = {r["rule"]: r["amount"] for r in found if r["rule"]}
    bits, order = {name: 1 << i for i, name in enumerate(rules)}, []
    while len(order) < len(rules):
        worth = {name: sum(n for mask, n in left.items() if mask & bit) / max(seconds.get(name, 0), 1e-9) for name, bit in bits.items() if name not in order}
        order.append(min(worth, key=lambda name: (-worth[name], name)))
        left = {mask: n for mask, n in left.items() if not mask & bits[order[-1]]}
    return order


def judged(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` for each row.

    Base counts are whole; the rules of the cascade run in ``order`` (measured
    by order_rules if None) until one rejects. Null and empty texts have no
    words and fail; equal texts get equal rows, repeated rows repeat, also those
    with a null doc_id; an empty table stays empty.
    """
    cascade = [RULES[name] for name in (order or order_rules(docs))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                t = Text(x.as_py() or b"")
                failed = base_failed(t)
                kept = not failed and not any(rejects(t) for rejects in cascade)
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.bool_()) for c in columns[5:])], names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema)
