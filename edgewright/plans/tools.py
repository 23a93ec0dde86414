"""Views of priors and of result graphs: neighbourhoods, JSON texts, several steps in one graph."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import priors
from ..sources import sinks, tables


def _edges(sif: DataFrame) -> DataFrame:
    return sif.where("target IS NOT NULL")


def _marks(lines: DataFrame) -> DataFrame:
    """node, row_id, letter, colour, border, value of the site marks in format lines."""
    part = F.split("setting", r"\|")
    at = lambda i: F.try_element_at(part, F.lit(i + 1))
    return lines.where("kind = 'node' AND property = 'rppasite'").select(F.col("id").alias("gene"), at(0).alias("row_id"), at(1).alias("letter"), at(2).alias("colour"), at(3).alias("border"), at(4).alias("value"))


def graph_view(sif: DataFrame, lines: DataFrame, seeds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Relations next to ``seeds`` (without seeds: those between the nodes that ``lines`` name), and the lines of what stays.

    Lines for all nodes or all edges stay; an edge's lines are those whose id
    is 'source type target'.
    """
    if seeds:
        kept = priors.neighborhood(_edges(sif), seeds)
    else:
        kept = priors.paths_between(_edges(sif), lines.where("kind = 'node' AND id <> 'all-nodes'").select(F.col("id").alias("gene")))
    nodes = kept.select(F.explode(F.array("source", "target")).alias("id"))
    ids = nodes.unionByName(kept.select(F.concat_ws(" ", "source", "rel_type", "target").alias("id"))).distinct()
    general = lines.where("id IN ('all-nodes', 'all-edges')")
    return kept, general.unionByName(lines.join(ids, "id", "left_semi").select(*lines.columns))


def graphs_below(spark: SparkSession, base: str) -> list[str]:
    """Paths, without extension, of all graph files at any depth under ``base``, file or written folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path")
    stem = F.regexp_extract("path", r"^(.*)\.sif(?:/part-[^/]*)?$", 1)
    return sorted(r.stem for r in files.select(stem.alias("stem")).where("stem <> ''").distinct().collect())  # names of files


def jsonize(spark: SparkSession, base: str) -> list[str]:
    """Write a .json folder (a text for each node and edge) beside every graph below ``base`` that has a format."""
    stems = graphs_below(spark, base)
    for stem in stems:
        sif, lines = tables.sif(spark, f"{stem}.sif"), tables.format_lines(spark, f"{stem}.format")
        listed = F.filter(F.split(F.coalesce("mediators", F.lit("")), "[; ]+"), lambda m: m != "")
        placed = F.filter(F.transform(F.split(F.coalesce("sites", F.lit("")), ";"), tables.parse_site), lambda s: s["pos"].isNotNull())
        edges = _edges(sif).withColumns({"mediators": listed, "sites": placed})
        sinks.graph_json(edges, lines).select("json").write.mode("overwrite").text(f"{stem}.json")
    return stems


def step_names(paths: list[str]) -> list[str]:
    """Names of steps: what is left of the paths without the beginning and the end that all share; the paths where nothing would be."""
    start = os.path.commonprefix(paths)
    rest = [p[len(start) :] for p in paths]
    end = os.path.commonprefix([r[::-1] for r in rest])
    names = [r[: len(r) - len(end)] for r in rest]
    return names if all(names) and len(set(names)) == len(names) else paths


def series_view(spark: SparkSession, stems: list[str]) -> tuple[DataFrame, DataFrame]:
    """Graphs of several steps in one: edges with the steps that have them, and for each step a mark of every row (a ghost where it is missing)."""
    if not stems:
        raise ValueError("no graphs to merge")
    steps = marks = None
    for name, stem in zip(step_names(stems), stems):
        step = F.lit(name).alias("step")
        edges = _edges(tables.sif(spark, f"{stem}.sif")).select(step, "source", "rel_type", "target")
        own = _marks(tables.format_lines(spark, f"{stem}.format")).select(step, "gene", "row_id", "colour")
        steps, marks = (edges, own) if steps is None else (steps.unionByName(edges), marks.unionByName(own))
    return sinks.series(steps, marks)
