"""False-discovery rates over the data that took part in a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.multiple_testing import q_values, thresholds
from ..model import PROTEOMIC


def family(data_type: Column, pool: bool) -> Column:
    """Proteomic types form one family if pooled."""
    return F.when(data_type.isin(PROTEOMIC), "protein").otherwise(data_type) if pool else data_type


def participants(found: DataFrame) -> DataFrame:
    """Distinct rows at either end of pairs: row_id, data_type, p."""
    a = found.select(F.col("src_row").alias("row_id"), F.col("src_type").alias("data_type"), F.col("src_p").alias("p"))
    b = found.select(F.col("tgt_row").alias("row_id"), F.col("tgt_type").alias("data_type"), F.col("tgt_p").alias("p"))
    return a.unionByName(b).distinct()


def data_thresholds(tested: DataFrame, q: dict[str, float], pool: bool = False, others: DataFrame | None = None) -> dict[str, float]:
    """p thresholds by data type for tested(row_id, data_type, p) (at most ten numbers come to the driver).

    A type of which no row was tested goes by all its rows at the ends of
    relations, ``others`` of the same columns. Types without rows there keep threshold 1: no relation can have one.
    """
    pooled = lambda t: pool and t in PROTEOMIC and "protein" in q
    rates = {t: q["protein"] if pooled(t) else own for t, own in q.items()}
    took_part = {r["data_type"] for r in tested.select("data_type").distinct().collect()}
    found = {}
    for rows, types in ((tested, [t for t in rates if t in took_part]), (others, [t for t in rates if t not in took_part])):
        if rows is None or not types:
            continue
        # rows tested of types without a rate of their own belong to the pool too
        kept = rows if rows is tested else rows.where(F.col("data_type").isin(types))
        families = kept.withColumn("family", family(F.col("data_type"), pool))
        by_rate = {rate: {r["family"]: r["threshold"] for r in thresholds(families, ["family"], rate).collect()} for rate in {rates[t] for t in types}}
        found |= {t: by_rate[rates[t]].get("protein" if pool and t in PROTEOMIC else t, 1.0) for t in types}
    return {t: found.get(t, 1.0) for t in rates}


def correlation_threshold(found: DataFrame, q: float) -> float:
    """Threshold over unordered pairs of rows with a correlation p."""
    tests = found.select(F.least("src_row", "tgt_row").alias("a"), F.greatest("src_row", "tgt_row").alias("b"), F.col("corr_p").alias("p")).where("p IS NOT NULL").distinct()
    return thresholds(tests.withColumn("family", F.lit("all")), ["family"], q).agg(F.coalesce(F.max("threshold"), F.lit(-1.0))).first()[0]


def value_changes(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """row_id, data class, value, p and q within the class (site-specific types share one)."""
    kind = F.when(F.col("data_type").isin("phosphoprotein", "acetylprotein", "methylprotein"), "site").otherwise(F.col("data_type"))
    both = rows.select("row_id", kind.alias("class")).join(changes, "row_id")
    return q_values(both, ["class"]).select("row_id", "class", "value", "p", "q", "sign")


def uniformity(tests: DataFrame, by: list[str]) -> DataFrame:
    """Ranked p against what uniform p-values would be."""
    from ..functions.multiple_testing import ranked

    return ranked(tests, by).select(*by, "p", (F.col("k") / F.col("m")).alias("expected")).distinct()
