"""Compression of vectors to four byte codes: integer product codebooks, nearest entries by Walsh-Hadamard coefficients."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import small, unused, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that are compared with a codebook at a time, and coefficients between two eliminations.
BLOCK, STEP = 256, 4


def padded_width(width: int) -> int:
    """The power of two that a part of ``width`` components is padded to."""
    return 1 << max(0, width - 1).bit_length()


def largest(width: int) -> int:
    """Size of a component up to which sums of squared coefficients stay within 63 bits."""
    return 1 << (60 - 2 * (padded_width(width).bit_length() - 1)) // 2 - 1


def transformed(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of integer rows, zero-padded to a power of two, in sequency order (by sign changes of their functions).

    Squared differences of two rows' coefficients add up to the padded width
    times the squared distance of the rows, and every partial sum is at most that.
    """
    width = padded_width(x.shape[1])
    out = np.zeros((len(x), width), np.int64)
    out[:, : x.shape[1]] = x
    half = 1
    while half < width:
        pair = out.reshape(len(x), width // (2 * half), 2, half)
        out = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), 2).reshape(len(x), width)
        half *= 2
    bits = width.bit_length() - 1
    gray = [i ^ (i >> 1) for i in range(width)]  # function i by sequency is number bit-reversed gray(i) by Hadamard's order
    return out[:, [int(format(g, f"0{bits}b")[::-1], 2) if bits else 0 for g in gray]]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lower one of ties, and the squared distance; exact integers.

    The first coefficients of all entries give lower bounds, and the most
    promising entry's whole sum an upper one. Entries above it go; the others
    gain further coefficients, step by step, until few are left.
    """
    c, scale = transformed(entries), padded_width(x.shape[1])
    entries_by_place = np.ascontiguousarray(c.T)
    best, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for start in range(0, len(x), BLOCK):
        t = transformed(x[start : start + BLOCK])
        by_place = np.ascontiguousarray(t.T)
        sums = np.zeros((len(t), len(c)), np.int64)
        for j in range(min(STEP, scale)):
            d = t[:, j, None] - c[None, :, j]
            sums += d * d
        likely = sums.argmin(1)
        rest = t - c[likely]
        bound = (rest * rest).sum(1)
        row, entry = np.nonzero(sums <= bound[:, None])
        left = sums[row, entry]
        for j in range(STEP, scale, STEP):
            for k in range(j, j + STEP):
                d = by_place[k][row] - entries_by_place[k][entry]
                left += d * d
            keep = left <= bound[row]
            row, entry, left = row[keep], entry[keep], left[keep]
        order = np.lexsort((entry, left, row))
        row, first = np.unique(row[order], return_index=True)
        best[start + row], error[start + row] = entry[order][first], left[order][first] // scale
    return best, error


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), width)


def _sums(vectors: DataFrame, books: list[np.ndarray]) -> list[tuple]:
    """(part, entry, count, sums by position) of the parts nearest to each entry; at most PARTS * ENTRIES rows."""
    width = books[0].shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((PARTS, ENTRIES), np.int64)
        total = np.zeros((PARTS, ENTRIES, width), np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), PARTS * width)
            for p, book in enumerate(books):
                x = v[:, p * width : (p + 1) * width]
                index, _ = nearest(x, book)
                np.add.at(total[p], index, x)
                count[p] += np.bincount(index, minlength=ENTRIES)
        part, entry = np.nonzero(count)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry], pa.int64()), pa.array(list(total[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

    each = vectors.select("v").mapInArrow(add, "part int, entry int, n long, sums array<long>")
    total = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)))
    return [(r[0], r[1], r[2], np.array(r[3:], np.int64)) for r in total.collect()]


def integer_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id, label, v`` of the rows whose vector is whole, v an array of longs of equal length, and the width of a part."""
    x = F.col("embedding")
    whole = vectors.where(x.isNotNull()).where(~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    length = whole.agg(F.max(F.size(x))).first()[0] or 0
    width = -(-length // PARTS)
    most = float(largest(width))
    scaled = F.transform(x, lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-most)), F.lit(most))))
    v = F.concat(scaled, F.array_repeat(F.lit(0).cast("long"), F.lit(PARTS * width) - F.size(x))) if width else F.array().cast("array<long>")
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), v.alias("v")), width


def trained(vectors: DataFrame, width: int) -> list[np.ndarray]:
    """The codebook of each part after ROUNDS rounds; the driver holds nothing but these (PARTS * ENTRIES entries)."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), PARTS * width)
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(PARTS)]
    for _ in range(ROUNDS if len(first) and width else 0):
        for part, entry, n, sums in _sums(vectors, books):
            books[part][entry] = sums // n
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in books for entry in book for x in entry).encode()).hexdigest()


def coded(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for each row of ``vectors(vec_id, embedding, label)`` with a whole vector.

    Rows whose vector is null, or has a null, NaN or infinite component, are
    left out. Components become floor(1024 x). Vectors shorter than the
    longest, or not of a multiple of four components, get zeros at the end;
    empty vectors are zeros. Sizes above ``largest`` (2^25 for parts of up to 16
    components: 32,768 before scaling) count as that size, so that all sums
    stay exact. A null vec_id comes after all others among the first 256;
    repeated rows count and return as often as they occur, in order of their
    vectors where ids are equal. With fewer than 256 vectors the codebooks
    have as many entries. An empty table gives an empty one.
    """
    kept, width = integer_vectors(vectors)
    kept = written(kept, "vectors")
    books = trained(kept, width)
    label = kept.schema["label"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, n = _matrix(batch.column("v"), PARTS * width), batch.num_rows
            found = [nearest(v[:, p * width : (p + 1) * width], b) for p, b in enumerate(books)] if width and n else [(np.zeros(n, np.int64),) * 2] * PARTS
            codes = [bytes(row).hex() for row in np.stack([i for i, _ in found], 1).astype(np.uint8)]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(sum(e for _, e in found), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    rows = written(kept.mapInArrow(code, f"vec_id long, label {label}, code string, error long"), "codes")
    same = unused("of", rows)
    totals = small(written(rows.groupBy(F.col("label").alias(same)).agg(F.sum("error").alias("label_error")), "label_errors"))
    out = rows.join(totals, F.col("label").eqNullSafe(F.col(same)))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def coded_sql() -> str:
    """The same by whole squared distances, for a table of 256 vectors or more of equal length."""
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, [floor({SCALE} * x::DOUBLE) for x in embedding] AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) r(p))",
        f"book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    for i in range(ROUNDS + 1):
        near = f"SELECT vec_id, p, e, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM parts JOIN book{i} USING (p)"
        steps.append(f"near{i} AS MATERIALIZED (SELECT vec_id, p, min(d) AS d, arg_min(e, d * 1000 + e) AS e FROM ({near}) GROUP BY ALL)")
        if i < ROUNDS:
            mean = f"SELECT p, e, i, floor(sum(x[i]) / count(*)) AS m FROM near{i} JOIN parts USING (vec_id, p), range(1, (SELECT max(len(x)) FROM parts) + 1) r(i) GROUP BY ALL"
            steps.append(f"moved{i} AS (SELECT p, e, list(m ORDER BY i) AS c FROM ({mean}) GROUP BY ALL)")
            steps.append(f"book{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN moved{i} m USING (p, e))")
    steps += [
        f"coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY 1)",
        f"sha AS (SELECT sha256(string_agg(array_to_string([x::BIGINT for x in c], ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})",
        "rows AS (SELECT vec_id, label, code, error FROM coded JOIN kept USING (vec_id))",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM rows, sha"
