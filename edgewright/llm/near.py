"""Near duplicates: texts whose sets of word shingles have a given Jaccard similarity.

Candidates come from the positional index of SimHash prints (``simhash.links``)
and from prefix filtering, which misses no pair. Parity prints count how far
two sets differ at least, so all but a few false candidates go without a look
at their texts; the sets themselves decide the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import simhash
from .graph import connected_components
from .work import discard, small, unused, written

#: Rows that the order of shingles is drawn from, and the most shingles placed in it by count. Neither changes a result: any order is exact.
ORDER_ROWS, ORDER_GRAMS = 20_000, 200_000
#: Postings of a shingle, as that sample has it, beyond which they are dealt to several tasks.
SPLIT = 20_000
#: Texts that Python handles at a time.
SLICE = 500


def gram_set(text: bytes | None, words: int) -> np.ndarray:
    """The distinct XXH64 of a text's shingles of ``words`` words, ascending; the whole sequence is one where it is shorter."""
    found = (text or b"").translate(simhash.LOWER).split()
    return np.unique(simhash.gram_hashes(found, words)) if found else np.empty(0, np.uint64)


def set_id(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), simhash.SEED)).view(np.int64))


def parity_print(grams: np.ndarray) -> np.ndarray:
    """Bit i tells whether an odd number of shingles fall on place i of 2 to 4 times as many places as shingles (64 at least).

    Shingles that two sets share cancel out, so their prints differ in at most
    as many bits as the sets differ in shingles.
    """
    bits = 64
    while bits < 2 * len(grams):
        bits *= 2
    at = ((grams >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def gram_sets(docs: DataFrame, words: int) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(sid, grams)``: a text's shingles, and a hash of them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                grams = [gram_set(x.as_py(), words) for x in whole.column(1).slice(at, SLICE)]
                yield pa.RecordBatch.from_arrays([pa.array(map(set_id, grams), pa.int64()), pa.array([g.view(np.int64) for g in grams], pa.list_(pa.int64()))], ["sid", "grams"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "sid long, grams array<long>")


def frequent_grams(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) of the shingles most frequent in some ORDER_ROWS rows, and how many rows of the whole that stands for."""
    step = max(1, docs.count() // ORDER_ROWS)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    counts = gram_sets(some, words).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n > 2")
    rows = counts.orderBy(F.desc("n"), "gram").limit(ORDER_GRAMS).toPandas().sort_values("gram")
    return rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(np.int64) * step


def shingled(docs: DataFrame, words: int, similarity: float, split: int = SPLIT) -> DataFrame:
    """``doc_id, sid, size, fp, parity, prefix, parts`` of each row.

    ``sid`` is a hash of the set, ``fp`` its SimHash print, ``prefix`` its
    s - ceil(similarity * s) + 1 rarest shingles, rarest first: two sets of that
    similarity share ceil(similarity * s) shingles of either, so under one order
    of all shingles their prefixes meet. ``parts`` tells into how many tasks the
    postings of each go (0: one).
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_grams(docs, words))
    schema = "doc_id long, sid long, size int, fp long, parity array<long>, prefix array<long>, parts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                rows = []
                for x in whole.column(1).slice(start, SLICE):
                    grams = gram_set(x.as_py(), words)
                    signed = grams.view(np.int64)
                    rank = np.zeros(len(grams), np.int64)
                    if len(often):
                        at = np.minimum(np.searchsorted(often, signed), len(often) - 1)
                        rank = np.where(often[at] == signed, counts[at], 0)
                    length = len(grams) - int(np.ceil(similarity * len(grams) - 1e-6)) + 1 if len(grams) else 0
                    first = np.lexsort((signed, rank))[:length]
                    parts = np.where(rank[first] > split, -(-rank[first] // split), 0).astype(np.int32)
                    rows.append((set_id(grams), len(grams), simhash.print_of(grams), parity_print(grams), signed[first], parts))
                columns = list(zip(*rows))
                types = pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(start, SLICE), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema)


def shared_postings(rows: DataFrame) -> DataFrame:
    """``gram, sid, size, pos`` of the prefix shingles that two sets or more have, each set once.

    Postings are shuffled once, by shingle and, for those with ``parts``, by
    the set's place among them; of the latter all stay.
    """
    each = rows.select("sid", "size", "parts", F.posexplode("prefix").alias("pos", "gram"))
    parts = F.element_at("parts", F.col("pos") + 1)
    part = F.when(parts > 0, F.pmod("sid", parts) + 1).otherwise(0).cast("int")
    # size and place in one number keep the shuffled rows short
    each = each.select("gram", part.alias("part"), "sid", (F.shiftleft(F.col("size").cast("long"), 32) + F.col("pos")).alias("at"))
    together, along = W.partitionBy("gram", "part"), W.partitionBy("gram", "part").orderBy("sid")
    each = each.withColumns({"before": F.lag("sid").over(along), "low": F.min("sid").over(together), "high": F.max("sid").over(together)})
    each = each.where("(before IS NULL OR before <> sid) AND (part > 0 OR low < high)")
    return each.select("gram", "sid", F.shiftright("at", 32).cast("int").alias("size"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"))


def may_meet(a: str, b: str, similarity: float) -> Column:
    """Whether two sets that share a shingle at these places of their prefixes can be alike: at most all before and all after it are shared too."""
    p, q, s, t = F.col(f"{a}.pos"), F.col(f"{b}.pos"), F.col(f"{a}.size"), F.col(f"{b}.size")
    most = F.least(p, q) + 1 + F.least(s - p - 1, t - q - 1)
    return most * (1 + similarity) >= similarity * (s + t) - 1e-9


def few_differ(a: str, b: str, similarity: float) -> Column:
    """Whether the parity prints of two sets differ in no more bits than sets of that similarity can: (s + t)(1 - J) / (1 + J).

    The longer print is folded to the length of the other.
    """
    x, y, s, t = F.col(f"{a}.parity"), F.col(f"{b}.parity"), F.col(f"{a}.size"), F.col(f"{b}.size")
    xor = lambda u, v: u.bitwiseXOR(v)
    half = lambda u: F.zip_with(F.slice(u, 1, F.shiftright(F.size(u), 1)), F.slice(u, F.shiftright(F.size(u), 1) + 1, F.shiftright(F.size(u), 1)), xor)
    x, y = F.when(F.size(x) > F.size(y), half(x)).otherwise(x), F.when(F.size(y) > F.size(x), half(y)).otherwise(y)
    bits = F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, k: n + k)
    sizes = F.least(s, t) >= similarity * F.greatest(s, t) - 1e-9
    # sizes within the ratio have prints of the same length or twice it, for a similarity of one half or more
    return sizes & F.when(F.greatest(F.size(x), F.size(y)) > 2 * F.least(F.size(x), F.size(y)), True).otherwise(bits * (1 + similarity) <= (1 - similarity) * (s + t) + 1e-9)


def alike(pairs: DataFrame, variants: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """``(u, v)``: smallest doc_ids of the pairs of ``pairs(sid, other)`` whose sets have that Jaccard similarity.

    Only the texts of the smallest doc_ids are read; each pair counts in either
    direction and once.
    """
    near = pairs.select(F.least("sid", "other").alias("sid"), F.greatest("sid", "other").alias("other")).distinct()
    prints = variants.select("sid", F.struct("size", "parity").alias("x"))
    others = prints.select(F.col("sid").alias("other"), F.col("x").alias("y"))
    near = near.join(prints, "sid").join(others, "other").where(few_differ("x", "y", similarity)).select("sid", "other")
    near = written(near, "candidates")
    ids = near.select("sid").unionByName(near.select(F.col("other").alias("sid"))).distinct().join(variants.select("sid", "vid"), "sid").select("vid")
    ids = written(ids, "needed")
    key = unused("vid", docs)
    ids = ids.withColumnRenamed("vid", key)
    texts = docs.join(small(ids), F.col("doc_id").cast("long") == F.col(key), "left_semi").select("doc_id", "text")
    sets = written(gram_sets(texts, words).dropDuplicates(["sid"]), "sets")
    both = near.join(sets.withColumnRenamed("grams", "mine"), "sid").join(sets.select(F.col("sid").alias("other"), F.col("grams").alias("theirs")), "other")
    common = F.size(F.array_intersect("mine", "theirs"))
    found = both.where(common * (1 + similarity) >= similarity * (F.size("mine") + F.size("theirs")) - 1e-9).select("sid", "other")
    named = variants.select("sid", F.col("vid").alias("u"))
    found = found.join(named, "sid").join(named.toDF("other", "v"), "other").select("u", "v")
    found = written(found, "alike")
    discard(sets, near, ids)
    return found


def print_pairs(variants: DataFrame, max_distance: int) -> DataFrame:
    """``(sid, other)``: sets whose SimHash prints differ in ``max_distance`` bits or fewer, by one set of each print."""
    first = variants.groupBy("fp").agg(F.min("sid").alias("id"))
    same = variants.join(first, "fp").where("sid <> id").select("sid", F.col("id").alias("other"))
    return same.unionByName(simhash.links(first, max_distance).toDF("sid", "other"))


def components(variants: DataFrame, postings: DataFrame, docs: DataFrame, words: int, similarity: float, max_distance: int = 3) -> DataFrame:
    """``(id, component)`` of the smallest doc_ids of sets that pairs of that similarity link; ids of no pair are missing.

    First come pairs of the prints' index, and each posting with the pivot of
    its shingle, the set that has it earliest in its prefix: in a group of near
    copies that is the one with the fewest shingles of its own. The pairs among
    the other postings of a shingle count only where their components still
    differ; the join emits those alone whose parity prints allow for it.
    """
    me = F.struct("pos", "sid", "size")
    pivots = postings.groupBy("gram").agg(F.min(me).alias("b"))
    star = postings.select("gram", me.alias("a")).join(pivots, "gram").where((F.col("a.sid") != F.col("b.sid")) & may_meet("a", "b", similarity))
    pairs = star.select(F.col("a.sid").alias("sid"), F.col("b.sid").alias("other")).unionByName(print_pairs(variants, max_distance))
    edges = alike(pairs, variants, docs, words, similarity)
    labels = written(connected_components(edges), "labels")

    named = variants.join(labels, F.col("vid") == F.col("id"), "left").select("sid", F.coalesce("component", "vid").alias("c"))
    rest = postings.join(pivots, "gram").where(F.col("sid") != F.col("b.sid")).select("gram", "sid", "size", "pos").join(named, "sid")
    mixed = rest.groupBy("gram").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("gram")
    rest = rest.join(mixed, "gram", "left_semi").join(variants.select("sid", "parity"), "sid")
    rest = written(rest.select("gram", F.struct("sid", "size", "pos", "parity", "c").alias("a")), "rest")
    left, right = rest, rest.toDF("g", "b")
    apart = (F.col("gram") == F.col("g")) & (F.col("a.c") < F.col("b.c")) & may_meet("a", "b", similarity) & few_differ("a", "b", similarity)
    more = left.join(right, apart).select(F.col("a.sid").alias("sid"), F.col("b.sid").alias("other"))
    return connected_components(edges.unionByName(alike(more, variants, docs, words, similarity)))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, split: int = SPLIT) -> DataFrame:
    """The rows of ``docs``, unchanged, but for near duplicates of a smaller doc_id.

    Two texts are near duplicates if their sets of shingles of ``words`` words
    have a Jaccard similarity of ``similarity`` (one half or more) or above;
    every such pair is found and decided by the sets. Of each group that they
    connect, the smallest doc_id stays. Null and empty texts, and others
    without words, are one group. Rows with a null doc_id stay; rows that
    repeat a doc_id share its fate. An empty table gives an empty one.
    """
    if not 0.5 <= similarity <= 1:
        raise ValueError("similarity must be 0.5 to 1")
    known = docs.where("doc_id IS NOT NULL")
    rows = written(shingled(known, words, similarity, split), "shingled")
    variants = rows.groupBy("sid").agg(F.min("doc_id").alias("vid"), *(F.first(c).alias(c) for c in ("size", "fp", "parity")))
    variants = written(variants, "variants")
    postings = written(shared_postings(rows), "postings")
    groups = components(variants, postings, known, words, similarity)
    kept = variants.join(groups, F.col("vid") == F.col("id"), "left").select("sid", F.coalesce("component", "vid").alias("kept"))
    key = unused("copy", docs)
    copies = rows.select("doc_id", "sid").join(kept, "sid").where("doc_id <> kept").select(F.col("doc_id").alias(key)).distinct()
    copies = written(copies, "copies")
    discard(rows, postings)
    return docs.join(small(copies), F.col("doc_id").cast("long") == F.col(key), "left_anti")
