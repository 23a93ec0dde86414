"""Benjamini-Hochberg as window expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import written


def ranked(tests: DataFrame, family: list[str], p: str = "p", key: list[str] | None = None) -> DataFrame:
    """Add k (rank of p within the family, ties by key) and m (tests with a p); rows without p go.

    Tests are written first: ranks are joined by p, and a p worked out twice, from
    values that arrive in another order, can differ in its last bit and meet no rank.
    """
    return _ranked(written(tests, "tests"), family, p, key)


def _ranked(tests: DataFrame, family: list[str], p: str, key: list[str] | None = None) -> DataFrame:
    tests = tests.where(F.col(p).isNotNull())
    order = [F.col(p), *(F.col(c) for c in key or [])]
    size = tests.groupBy(*family).agg(F.count("*").alias("m")) if family else tests.agg(F.count("*").alias("m"))
    sized = tests.join(size, family) if family else tests.crossJoin(F.broadcast(size))
    # equal p share the largest of their ranks, so counts of smaller or equal p suffice
    counts = tests.groupBy(*family, p).agg(F.count("*").alias("n"))
    upto = counts.withColumn("k", F.sum("n").over(W.partitionBy(*(family or [F.lit(1)])).orderBy(p))).drop("n")
    return sized.join(upto, [*family, p])


def thresholds(tests: DataFrame, family: list[str], q: float, p: str = "p") -> DataFrame:
    """Largest p with p <= q k / m in each family; -1 (nothing passes) if there is none."""
    with_rank = ranked(tests, family, p)
    best = F.max(F.when(F.col(p) <= F.lit(float(q)) * F.col("k") / F.col("m"), F.col(p)))
    grouped = with_rank.groupBy(*family) if family else with_rank.groupBy()
    return grouped.agg(F.coalesce(best, F.lit(-1.0)).alias("threshold"))


def q_values(tests: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """Add q, the least p m / k over this and larger p, at most 1."""
    tests = written(tests, "tests")
    with_rank = _ranked(tests, family, p)
    steps = with_rank.select(*family, p, (F.col(p) * F.col("m") / F.col("k")).alias("raw")).distinct()
    over = W.partitionBy(*(family or [F.lit(1)])).orderBy(F.col(p).desc())
    steps = steps.withColumn("q", F.least(F.min("raw").over(over), F.lit(1.0))).drop("raw")
    return tests.join(steps, [*family, p], "left")
