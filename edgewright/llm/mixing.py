"""Mixing sources to target weights by iterative proportional fitting.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import unused, written

DIMENSIONS = ("source", "lang", "topic")
#: Cells (distinct source, language, topic) up to which their table is broadcast: 50,000 rows of under 200 bytes.
BROADCAST_CELLS = 50_000
BLANKS = " \t\n\u000b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic(text: Column, tokens: Column) -> Column:
    """What kind of text it is: empty, table, symbols, shouting, note, article or long."""
    taken = lambda of: F.length(text) - F.length(F.translate(text, of, ""))
    return (
        F.when(tokens == 0, "empty")
        .when(4 * taken("|") > tokens, "table")
        .when(4 * taken("#*$%&<>") > tokens, "symbols")
        .when(2 * taken("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > F.length(text), "shouting")
        .when(tokens < 100, "note")
        .when(tokens < 1000, "article")
        .otherwise("long")
    )


def described(docs: DataFrame) -> DataFrame:
    """The columns that mixing needs, beside nothing else; null source or language counts as ''."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.col("text").cast("string").alias("text"),
    ).withColumn("n_tokens", token_count(F.col("text")))
    return rows.withColumn("topic", topic(F.col("text"), F.col("n_tokens"))).drop("text")


def targets(cells: DataFrame, dimension: str, temperature: float) -> DataFrame:
    """Target shares of one dimension: its token shares to the power ``temperature``, made to sum to 1."""
    total = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("n")).where("n > 0").withColumn("n", F.pow("n", F.lit(temperature)))
    return total.crossJoin(total.agg(F.sum("n").alias("all"))).select(dimension, (F.col("n") / F.col("all")).alias("share"))


def rake(cells: DataFrame, shares: dict[str, DataFrame], budget: float, rounds: int = 25, tolerance: float = 1e-4) -> DataFrame:
    """``cells(source, lang, topic, tokens, ...)`` with the sampling probability ``p`` of each cell.

    Each round scales p so that the expected tokens of every source, then of
    every language, then of every topic meet share * budget, then bounds p by
    1. It ends when no p moves by more than ``tolerance`` of itself. Cells
    without tokens keep p = 1.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    start = min(1.0, budget / total) if total else 1.0
    cells = cells.withColumn("p", F.when(F.col("tokens") > 0, F.lit(start)).otherwise(1.0))
    for dimension, share in shares.items():
        cells = cells.join(share.withColumnRenamed("share", f"share_{dimension}"), dimension, "left")
    cells = written(cells, "cells")
    for _ in range(rounds if total else 0):
        now = cells.withColumn("was", F.col("p"))
        for dimension in shares:
            got = F.sum(F.col("p") * F.col("tokens")).over(W.partitionBy(dimension))
            ratio = F.coalesce(f"share_{dimension}", F.lit(0.0)) * budget / got
            now = now.withColumn("p", F.when((F.col("tokens") > 0) & (got > 0), F.col("p") * ratio).otherwise(F.col("p")))
        now = now.withColumn("p", F.least("p", F.lit(1.0)))
        now = written(now, "cells")
        moved = now.agg(F.max(F.abs(F.col("p") - F.col("was")) / F.greatest("was", F.lit(1e-12)))).first()[0]
        cells = now.drop("was")
        if not moved or moved < tolerance:
            break
    return cells.select(*DIMENSIONS, F.round("p", 9).alias("p"))


def probabilities(rows: DataFrame, temperature: float = 0.7, budget_share: float = 0.5, shares: dict[str, DataFrame] | None = None) -> DataFrame:
    """Raked sampling probability of each cell of ``rows(source, lang, topic, n_tokens)``.

    ``shares`` may give a table (dimension, share) for any dimension, summing
    to 1; what it has no share for is not drawn. Other dimensions go by
    ``targets``.
    """
    cells = written(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    shares = {d: (shares or {}).get(d, None) or targets(cells, d, temperature) for d in DIMENSIONS}
    budget = float((cells.agg(F.sum("tokens")).first()[0] or 0) * budget_share)
    return rake(cells, shares, budget)


def marginals(rows: DataFrame, cells: DataFrame, shares: dict[str, DataFrame], budget: float) -> DataFrame:
    """``dimension, name, wanted, expected``: tokens that each target asks for and that the probabilities of ``cells`` give.

    Where p is 1 throughout, or targets exclude each other, the two differ:
    ``expected`` below ``wanted`` tells that there is no more text of the kind.
    """
    given = rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")).join(cells, list(DIMENSIONS))
    out = None
    for d, share in shares.items():
        got = given.groupBy(d).agg(F.sum(F.col("tokens") * F.col("p")).alias("expected"))
        part = share.join(got, d, "full").select(F.lit(d).alias("dimension"), F.col(d).alias("name"), (F.coalesce("share", F.lit(0.0)) * budget).alias("wanted"), F.coalesce("expected", F.lit(0.0)).alias("expected"))
        out = part if out is None else out.unionByName(part)
    return out


def with_probability(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Join the cell's p to each row. The cells are broadcast below BROADCAST_CELLS of them, else joined by shuffle with skew handling."""
    small = cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    return rows.join(F.broadcast(cells) if small else cells, list(DIMENSIONS))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on doc_id and seed alone."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) / F.lit(float(1 << 53))


def sampled(docs: DataFrame, temperature: float = 0.7, budget_share: float = 0.5, seed: int = 17, shares: dict[str, DataFrame] | None = None) -> DataFrame:
    """The documents drawn: ``doc_id, source, lang, topic, n_tokens, probability``.

    A document stays if its own hash number is below its cell's probability,
    so any partitioning gives the same sample and repeated doc_ids share one
    fate, as do all rows without a doc_id. Texts without words stay. Null
    sources and languages form the cell ''; a null text has no tokens. An empty
    table gives an empty one. ``shares``: see ``probabilities``.
    """
    rows = written(described(docs), "described")
    drawn = with_probability(rows, probabilities(rows, temperature, budget_share, shares)).where(uniform(F.col("doc_id"), seed) < F.col("p"))
    return drawn.select("doc_id", "source", "lang", "topic", "n_tokens", F.col("p").alias("probability"))


def mixed(docs: DataFrame, temperature: float = 0.7, budget_share: float = 0.5, seed: int = 17, shares: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of ``docs`` drawn by the same rule, unchanged; nulls, empty texts, repeats and empty tables as in ``sampled``."""
    cells = probabilities(written(described(docs), "described"), temperature, budget_share, shares)
    source, lang, kind_of, p = (unused(c, docs) for c in (*(f"cell_{d}" for d in DIMENSIONS), "cell_p"))
    cells = cells.select(F.col("source").alias(source), F.col("lang").alias(lang), F.col("topic").alias(kind_of), F.col("p").alias(p))
    small = cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    text = F.col("text").cast("string")
    kind = topic(text, token_count(text))
    of = {source: F.coalesce(F.col("source").cast("string"), F.lit("")), lang: F.coalesce(F.col("lang").cast("string"), F.lit("")), kind_of: kind}
    rows = docs.withColumns(of).join(F.broadcast(cells) if small else cells, list(of))
    return rows.where(uniform(F.col("doc_id").cast("long"), seed) < F.col(p)).select(*docs.columns)
