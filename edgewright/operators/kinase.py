"""Kinase activity from sequence windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.multiple_testing import q_values
from ..functions.stats import signed_log
from .pairwise import spearman


def sequence_windows(rows: DataFrame, sequences: DataFrame, before: int = 5, after: int = 4) -> DataFrame:
    """row_id, window: residues before..after the site of phospho rows with one site for each protein.

    ``sequences(gene, sequence)``. All proteins of a row must have the same
    window; rows with several sites of a protein, or a site whose window runs
    over the ends, have none.
    """
    sites = rows.where("data_type = 'phosphoprotein'").select("row_id", F.explode("sites").alias("s")).select("row_id", "s.gene", "s.pos").distinct()
    single = sites.groupBy("row_id").agg(F.count("*").alias("n"), F.count_distinct("gene").alias("g")).where("n = g").select("row_id")
    placed = sites.join(single, "row_id", "left_semi").join(sequences, "gene", "left")
    fits = (F.col("pos") > before) & (F.col("pos") + after <= F.length("sequence"))
    window = F.when(fits, F.substring("sequence", F.col("pos") - before, F.lit(before + after + 1)))
    got = placed.groupBy("row_id").agg(F.min(window).alias("window"), F.max(window).alias("w2"), F.count(F.when(window.isNull(), 1)).alias("missing"))
    return got.where("missing = 0 AND window = w2").select("row_id", "window")


def window_values(rows: DataFrame, changes: DataFrame, sequences: DataFrame) -> DataFrame:
    """window, value: the change of each sequence window; of rows with one window the last by row_id counts, rows without a change don't."""
    windows = sequence_windows(rows, sequences).join(changes.where("value IS NOT NULL").select("row_id", "value"), "row_id")
    return windows.groupBy("window").agg(F.max_by("value", "row_id").alias("value"))


def sequences_by_change(rows: DataFrame, changes: DataFrame, sequences: DataFrame) -> DataFrame:
    """Windows in order of their change, the smallest first; equal changes by window."""
    return window_values(rows, changes, sequences).orderBy("value", "window")


def window_scores(windows: DataFrame, weights: DataFrame, before: int = 5) -> DataFrame:
    """window, kinase, score: sum over the window's places of the logarithm (base 2) of the weight that the kinase gives the residue there.

    ``weights(kinase, place, residue, weight)``: places count from the site (0).
    A residue without a weight counts as 1; a kinase that knows none of a window's residues has no score for it.
    """
    letters = windows.select("window", F.posexplode(F.split("window", ""))).select("window", (F.col("pos") - before).alias("place"), F.upper("col").alias("residue"))
    known = weights.where("weight > 0").select("kinase", "place", F.upper("residue").alias("residue"), F.log2("weight").alias("w"))
    return letters.join(known, ["place", "residue"]).groupBy("window", "kinase").agg(F.sum("w").alias("score"))


def kinase_activity(rows: DataFrame, changes: DataFrame, sequences: DataFrame, scores: DataFrame) -> DataFrame:
    """kinase, n, r, p, signed value, q: Spearman of changes with the kinase's score of each window, ``scores(window, kinase, score)``."""
    both = window_values(rows, changes, sequences).join(scores, "window").select("kinase", F.col("value").alias("x"), F.col("score").alias("y"))
    tested = spearman(both, ["kinase"]).withColumn("family", F.lit("kinase"))
    out = q_values(tested, ["family"])
    return out.select("kinase", "n", "r", "p", signed_log(F.col("p"), F.signum("r")).alias("value"), "q")


def library_activity(rows: DataFrame, changes: DataFrame, sequences: DataFrame, weights: DataFrame) -> DataFrame:
    """``kinase_activity`` by the weights of a kinase library."""
    windows = sequence_windows(rows, sequences).select("window").distinct()
    return kinase_activity(rows, changes, sequences, window_scores(windows, weights))


def empirical_rank_p(both: DataFrame, iterations: int = 5000, seed: int = 1) -> DataFrame:
    """kinase, p: share of random orders of the values whose mean-rank product sum reaches the observed one."""
    place = both.withColumn("rx", F.rank().over(W.partitionBy("kinase").orderBy("x"))).withColumn("ry", F.rank().over(W.partitionBy("kinase").orderBy("y")))
    observed = place.groupBy("kinase").agg(F.sum(F.col("rx") * F.col("ry")).alias("s"))
    many = place.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    drawn = F.row_number().over(W.partitionBy("kinase", "iter").orderBy(F.xxhash64("x", "y", "iter", F.lit(seed))))
    sums = many.withColumn("slot", drawn).groupBy("kinase", "iter").agg(F.sum(F.col("slot") * F.col("ry")).alias("z"))
    return sums.join(observed, "kinase").groupBy("kinase").agg(F.greatest(F.avg((F.col("z") >= F.col("s")).cast("double")), F.lit(1.0 / iterations)).alias("p"))
