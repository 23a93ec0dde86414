"""SimHash near-duplicate detection over a byte-position inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .work import written

SEED = 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
POSITIONS = 8


def gram_hashes(found: list[bytes], words: int) -> np.ndarray:
    """XXH64 of the shingles of ``words`` words, repeats included (the whole sequence if there are fewer words)."""
    joined = b" ".join(found)
    stops = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], stops[:-1])).tolist()
    ends = (stops - 1).tolist()[min(words, len(found)) - 1 :]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends)]), ">u8").astype(np.uint64)


def print_of(hashes: np.ndarray) -> int:
    """The SimHash of 64-bit hashes, as a signed number: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        rows = hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text as an unsigned number.

    ``bytes.split`` splits at exactly the six ASCII blanks (space, \\t to \\r).
    """
    found = (text or b"").translate(LOWER).split()
    return print_of(gram_hashes(found, words)) % (1 << 64) if found else 0


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp bigint)``, one row for each row; a null text counts as empty (0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), words) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def _byte(fp: Column, at: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * at).bitwiseAND(F.lit(255))


def blocks(max_distance: int, size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` byte positions, one of which any linked pair shares whole.

    d differing bits leave at least 8 - d of the 8 bytes equal, so each set of
    8 - d positions must hold one of these; the set that serves most is taken
    until all are served.
    """
    open_sets = {frozenset(x) for x in combinations(range(POSITIONS), POSITIONS - max_distance)}
    choices, taken = list(combinations(range(POSITIONS), size)), []
    while open_sets:
        best = max(choices, key=lambda c: sum(x.issuperset(c) for x in open_sets))
        taken.append(best)
        open_sets = {x for x in open_sets if not x.issuperset(best)}
    return taken


def key_size(n: int, max_distance: int) -> int:
    """Byte positions in a posting's key: so many that pairs which share a key by chance are no more than the ``n`` prints, if that can be."""
    most = POSITIONS - max_distance
    for size in range((most + 1) // 2, most):
        if len(blocks(max_distance, size)) * n / 2 <= 256**size:
            return size
    return most


def links(prints: DataFrame, max_distance: int = 3, size: int | None = None) -> DataFrame:
    """``prints(id, fp)`` with distinct fp -> ``(u, v)``, each pair at ``max_distance`` or fewer bits once.

    The inverted index has a posting for each set of byte positions in
    ``blocks`` and its bytes; keys grow with the number of prints, so pairs
    that meet by chance stay in proportion to it. For a pair of postings the
    positional bytes that the two share are tallied, pairs with the guaranteed
    minimum pass, and their differing bits are verified. A pair counts only under the
    first set it shares, so nothing is emitted twice. A fingerprint has at most
    C(64,0..3) = 43,745 others in reach, so the links are linear in the
    distinct fingerprints; long posting lists are split by Spark's skew join.
    """
    if not 0 <= max_distance < POSITIONS:
        raise ValueError("with 8 bytes, at most 7 bits may differ")
    sets = blocks(max_distance, size or key_size(prints.count(), max_distance))
    keys = [
        F.struct(F.lit(i).alias("block"), sum((F.shiftleft(_byte(F.col("fp"), p), 8 * k) for k, p in enumerate(ps)), F.lit(0).cast("long")).alias("key"))
        for i, ps in enumerate(sets)
    ]
    index = prints.select("id", "fp", F.explode(F.array(*keys)).alias("k")).select("id", "fp", "k.block", "k.key")
    a, b = index.alias("a"), index.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    same = [_byte(differ, p) == 0 for p in range(POSITIONS)]
    tally = sum((s.cast("int") for s in same), F.lit(0))
    # bit p of the mask: byte p is shared
    mask = sum((F.when(s, 1 << p).otherwise(0) for p, s in enumerate(same)), F.lit(0))
    masks = F.array(*(F.lit(sum(1 << p for p in ps)) for ps in sets))
    first = F.array_position(F.transform(masks, lambda m: mask.bitwiseAND(m) == m), F.lit(True)) - 1
    kept = (tally >= POSITIONS - max_distance) & (F.bit_count(differ) <= max_distance) & (first == F.col("a.block"))
    return a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & kept).select(
        F.col("a.id").alias("u"), F.col("b.id").alias("v")
    )


def components(docs: DataFrame, words: int = 3, max_distance: int = 3) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fingerprint, component_id, n_links``.

    Equal fingerprints collapse to one before the index is built, so copies
    cost nothing further; ``component_id`` is the smallest doc_id that links
    reach, ``n_links`` the number of other fingerprints linked directly. Texts
    without words have fingerprint zero and link like any other; rows that
    repeat a doc_id repeat in the result; an empty table gives an empty one.
    A row whose doc_id is null gets its fingerprint, and as component the
    smallest id that is not null.
    """
    prints = written(fingerprints(docs, words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("id"))
    pairs = written(links(distinct.where("id IS NOT NULL"), max_distance), "links")
    members = connected_components(pairs)
    degree = pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).groupBy("u").agg(F.count("*").alias("n"))
    labels = (
        distinct.join(members, "id", "left")
        .join(degree.withColumnRenamed("u", "id"), "id", "left")
        .select("fp", F.coalesce("component", "id").alias("component_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))
    )
    return prints.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
