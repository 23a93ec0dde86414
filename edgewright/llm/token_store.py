"""Token-id store: byte planes of fixed-size id blocks, zstandard, chunk index.

A store is a Parquet table under a path; each row is one record::

    shard int          range of doc_ids, ascending
    record int         within the shard, ascending
    doc_ids, n_tokens  array<bigint>: the documents of the record, in order
    n_ids bigint       ids in the record
    block_ids int      ids in each block but the last
    index array<struct<block, plane, at, size>>   where each plane lies
    payload binary     the compressed planes, one after another

A block is a fixed number of ids as little-endian unsigned 32-bit integers,
transposed into four byte planes; a plane of one value only (the high bytes,
with a small vocabulary) shrinks to a few bytes. A record ends with a document,
so each can be decoded by itself.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import new_path, text_batches

PLANES = 4
SCHEMA = (
    "shard int, record int, doc_ids array<bigint>, n_tokens array<bigint>, n_ids bigint, block_ids int, "
    "index array<struct<block:int,plane:int,at:bigint,size:int>>, payload binary"
)


def encode_blocks(ids: np.ndarray, block_ids: int, level: int = 3) -> tuple[list[dict], bytes]:
    """The planes of ``ids`` and their index."""
    press, index, parts, at = zstandard.ZstdCompressor(level=level), [], [], 0
    for block, start in enumerate(range(0, len(ids), block_ids)):
        rows = ids[start : start + block_ids].astype("<u4").view(np.uint8).reshape(-1, PLANES)
        for plane in range(PLANES):
            data = press.compress(np.ascontiguousarray(rows[:, plane]).tobytes())
            index.append({"block": block, "plane": plane, "at": at, "size": len(data)})
            parts.append(data)
            at += len(data)
    return index, b"".join(parts)


def decode_blocks(index: list[dict], payload: bytes, n_ids: int, block_ids: int) -> np.ndarray:
    """Inverse of encode_blocks."""
    expand, out = zstandard.ZstdDecompressor(), np.empty((n_ids, PLANES), np.uint8)
    for entry in index:
        start = entry["block"] * block_ids
        stop = min(n_ids, start + block_ids)
        data = expand.decompress(payload[entry["at"] : entry["at"] + entry["size"]], max_output_size=block_ids)
        out[start:stop, entry["plane"]] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


#: A space or line end before other white space or the end of the text.
LOOSE = re.compile(r"[ \n](?:\s|\Z)")


class Encoder:
    """Ids of whole texts, by way of the ids of their blank-separated pieces.

    A byte-level BPE never merges over the boundary before a single space or
    line end that a character other than white space follows, so the pieces of
    a text can be encoded apart, and common ones only once in each worker. New
    pieces are encoded many at a time; a token that begins with a space or line
    end begins a piece. A text in which other white space or nothing follows a
    space or line end is given to the tokenizer whole. When the memory
    is full, pieces met once are forgotten.
    """

    FULL = 1_000_000  # pieces, of about 200 bytes each: a worker keeps them from task to task
    BEGIN = ("\u0120", "\u010a")  # how byte-level BPE writes a space and a line end

    def __init__(self, path: str, full: int | None = None):
        from tokenizers import Tokenizer

        self.full = full or self.FULL
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith(self.BEGIN) for i in range(size)])
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(1 << 20, np.uint32)
        self.stops = np.zeros(1 << 18, np.int64)  # of piece k from stops[k] to stops[k + 1]
        self.again = np.zeros(1 << 18, bool)  # used in a batch after its own

    def trim(self) -> None:
        """Forget the pieces that were not met again; all of them if that leaves more than half."""
        names, keep = list(self.known), np.flatnonzero(self.again[: len(self.known)])
        if 2 * len(keep) > self.full:
            self.clear()
            return
        begin, sizes = self.stops[keep], np.diff(self.stops)[keep]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(begin - (ends - sizes), sizes) + np.arange(sizes.sum())]
        self.known = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.ids[: len(ids)] = ids
        self.stops[1 : len(keep) + 1] = ends
        self.again[:] = False

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> None:
        lines = [x for x in pieces if x[0] == "\n"]
        words = [x for x in pieces if x[0] != "\n"]
        pieces = words + lines
        (ids,) = self.encode(["".join([" " * bool(words), " ".join(words), *lines])])
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(pieces):  # an unusual vocabulary
            each = self.encode([*(" " + x for x in words), *lines])
            ids, starts = np.concatenate(each), np.cumsum([0, *map(len, each)])[:-1]
        n, at = len(self.known), int(self.stops[len(self.known)])
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty(len(self.ids), np.uint32)))
        while n + len(pieces) + 1 > len(self.stops):
            self.stops = np.concatenate((self.stops, np.zeros(len(self.stops), np.int64)))
            self.again = np.concatenate((self.again, np.zeros(len(self.again), bool)))
        self.ids[at : at + len(ids)] = ids
        self.stops[n + 1 : n + 1 + len(pieces)] = at + np.append(starts[1:], len(ids))
        self.known.update(zip(pieces, range(n, n + len(pieces))))

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.full:
            self.trim()
        before = len(self.known)
        heads, pieces, counts = [], [], []
        for text in texts:
            if LOOSE.search(text):
                heads.append(text)
                counts.append(0)
                continue
            cut = text.replace("\n", " \n").split(" ")
            heads.append(cut[0])
            counts.append(len(cut) - 1)
            del cut[0]
            pieces += cut
        at = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self.learn(list({pieces[i] for i in new}))
            at[new] = [self.known[pieces[i]] for i in new]
        self.again[at[at < before]] = True
        begin = self.stops[at]
        sizes = self.stops[at + 1] - begin
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(begin - (ends - sizes), sizes) + np.arange(n)]
        cuts = np.append(0, ends)[np.cumsum([0, *counts])]
        return [np.concatenate((head, ids[a:b])) for head, a, b in zip(self.encode(heads), cuts, cuts[1:])]


_ENCODERS: dict[tuple[str, int | None], Encoder] = {}


def _encoder(path: str, pieces: int | None) -> Encoder:
    """The worker's encoder; it holds one at a time."""
    if (path, pieces) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, pieces] = Encoder(path, pieces)
    return _ENCODERS[path, pieces]


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_ids: int = 1 << 16, record_ids: int = 1 << 20, pieces: int | None = None) -> None:
    """Encode ``docs(doc_id, text)`` and write the store at ``path``.

    Texts are dealt into ranges of doc_id and sorted within each; every text,
    also an empty or null one, ends with ``end_id``. Rows with equal doc_id
    keep one order (by text); a null doc_id comes first. ``tokenizer`` is the
    path of a tokenizer file that every executor has, ``pieces`` how many pieces
    of texts a worker remembers. An empty table gives a
    store without records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, record = _encoder(tokenizer, pieces), TaskContext.get().partitionId(), 0
        doc_ids, sizes, parts, held = [], [], [], 0
        end = np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            index, payload = encode_blocks(ids, block_ids)
            row = [shard, record, doc_ids, sizes, len(ids), block_ids, index, payload]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, fields)], schema=fields)

        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for start in range(0, len(ids_of), 256):
                for doc_id, ids in zip(ids_of[start : start + 256], encode.batch([x or "" for x in texts[start : start + 256].to_pylist()])):
                    doc_ids.append(doc_id)
                    sizes.append(len(ids) + 1)
                    parts += [ids, end]
                    held += len(ids) + 1
                    if held >= record_ids:
                        yield flush()
                        record, doc_ids, sizes, parts, held = record + 1, [], [], [], 0
        if doc_ids:
            yield flush()

    entry = pa.struct([("block", pa.int32()), ("plane", pa.int32()), ("at", pa.int64()), ("size", pa.int32())])
    fields = pa.schema(
        [
            ("shard", pa.int32()), ("record", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())),
            ("n_ids", pa.int64()), ("block_ids", pa.int32()), ("index", pa.list_(entry)), ("payload", pa.binary()),
        ]
    )
    text_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, SCHEMA).write.option("compression", "none").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document of the store, decoded record by record."""
    records = spark.read.schema(SCHEMA).parquet(path)
    # one row for each shard: as many as there were tasks
    shards = records.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    totals = np.cumsum([0, *(r["n"] for r in shards)]).tolist()
    base = spark.createDataFrame([(r["shard"], n) for r, n in zip(shards, totals)], "shard int, base bigint")
    within = W.partitionBy("shard").orderBy("record").rowsBetween(W.unboundedPreceding, -1)
    begin = records.select("shard", "record", "n_ids").withColumn("before", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    begin = begin.join(base, "shard").select("shard", "record", (F.col("base") + F.col("before")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_blocks(row["index"], row["payload"], row["n_ids"], row["block_ids"])
                stops = np.cumsum(row["n_tokens"])
                crcs = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(stops.tolist(), row["n_tokens"])]
                shard, record = (np.full(len(crcs), row[c], np.int32) for c in ("shard", "record"))
                arrays = [pa.array(shard), pa.array(record), pa.array(row["doc_ids"], pa.int64()), pa.array(stops - row["n_tokens"], pa.int64()), pa.array(row["n_tokens"], pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["shard", "record", "doc_id", "within", "n_tokens", "ids_crc32"])

    decoded = records.mapInArrow(run, "shard int, record int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return decoded.join(begin, ["shard", "record"]).select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 2, pieces: int | None = None) -> DataFrame:
    """Write a store for ``docs`` in the shared folder and return what reading it back gives."""
    path = new_path(docs.sparkSession, "tokens")
    write_store(docs, path, tokenizer, end_id, pieces=pieces)
    return read_store(docs.sparkSession, path)
