"""Prior relations: merging, conflicts, filters, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import RELATION, RELATION_TYPES, acts_on, rel_sign
from ..shared import written

FILTERS = ["no-filter", "phospho-only", "site-specific-only", "expression-only", "without-expression", "phospho-primary-expression-secondary"]
OPPOSITES = [("phosphorylates", "dephosphorylates", True), ("upregulates-expression", "downregulates-expression", False), ("acetylates", "deacetylates", True), ("methylates", "demethylates", True), ("activates-gtpase", "inhibits-gtpase", False)]


def first_of_each(priors: DataFrame, order: str) -> DataFrame:
    """One row for each (source, type, target): the one of least ``order`` (line number, precedence)."""
    first = F.row_number().over(W.partitionBy(*RELATION).orderBy(order))
    return priors.withColumn("__n", first).where("__n = 1").drop("__n")


def with_additional(priors: DataFrame, more: list[DataFrame]) -> DataFrame:
    """Further relations after those already there; one already there stays as it is."""
    ranked = priors.withColumn("__p", F.lit(0))
    for i, extra in enumerate(more, 1):
        ranked = ranked.unionByName(extra.select(*priors.columns).withColumn("__p", F.lit(i)))
    return first_of_each(ranked, "__p").drop("__p")


def merged(graphs: list[DataFrame]) -> DataFrame:
    """Union of networks: equal edges become one with all mediators and sites."""
    every = graphs[0]
    for g in graphs[1:]:
        every = every.unionByName(g.select(*every.columns))
    both = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return every.groupBy(*RELATION).agg(both("mediators"), both("sites"))


def _papers(mediators: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.coalesce(mediators, F.array()), lambda m: m.startswith("PMID:"))))


def _opposite(rel_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for a, b, _ in OPPOSITES:
        out = F.when(rel_type == a, b).when(rel_type == b, a).otherwise(out)
    return out


def without_conflicts(priors: DataFrame) -> DataFrame:
    """Drop what two opposite relations of one pair contradict: the side with fewer papers, both if equal.

    Of site-specific types only the common sites go, and a relation stays that
    loses sites; of the others the relation itself goes.
    """
    site_types = [t for a, b, s in OPPOSITES if s for t in (a, b)]
    rows = priors.withColumn("__n", _papers(F.col("mediators"))).withColumn("__o", _opposite(F.col("rel_type")))
    other = rows.select("source", F.col("rel_type").alias("__o"), "target", F.col("__n").alias("__on"), F.col("sites").alias("__os"))
    both = rows.join(other, ["source", "__o", "target"], "left")
    weaker = F.col("__on").isNotNull() & (F.col("__n") <= F.col("__on"))
    by_site = F.col("rel_type").isin(site_types)
    sites = F.when(by_site & weaker, F.array_except("sites", F.coalesce("__os", F.expr("filter(sites, x -> false)")))).otherwise(F.col("sites"))
    return both.where(by_site | ~weaker).withColumn("sites", sites).select(*priors.columns)


def _kind(rel_type: Column, kinds: set[str], strict: bool) -> Column:
    return rel_type.isin([t for t, _, _ in RELATION_TYPES if acts_on(t, strict) in kinds])


def relation_filter(priors: DataFrame, name: str, strict: bool = False) -> DataFrame:
    """Filter before the analysis; an unknown name is an error."""
    if name not in FILTERS:
        raise ValueError(f"unknown relation filter: {name}")
    t = F.col("rel_type")
    if name == "phospho-only":
        return priors.where(_kind(t, {"phospho"}, strict))
    if name == "site-specific-only":
        return priors.where(_kind(t, {"phospho", "acetyl", "methyl"}, strict))
    if name == "expression-only":
        return priors.where(_kind(t, {"expression"}, strict))
    if name == "without-expression":
        return priors.where(~_kind(t, {"expression"}, strict))
    return priors


def gene_focus(priors: DataFrame, genes: list[str]) -> DataFrame:
    return priors.where(F.col("source").isin(genes) | F.col("target").isin(genes)) if genes else priors


def phospho_primary(relations: DataFrame, strict: bool = False) -> DataFrame:
    """Phospho relations, and others that touch a gene of those."""
    phospho = relations.where(_kind(F.col("rel_type"), {"phospho"}, strict))
    genes = phospho.select(F.col("source").alias("g")).unionByName(phospho.select(F.col("target").alias("g"))).distinct()
    rest = relations.where(~_kind(F.col("rel_type"), {"phospho"}, strict))
    marked = rest.join(genes.select(F.col("g").alias("source"), F.lit(True).alias("__s")), "source", "left").join(genes.select(F.col("g").alias("target"), F.lit(True).alias("__t")), "target", "left")
    return phospho.unionByName(marked.where("__s OR __t").select(*relations.columns))


def current_symbols(aliases: DataFrame, rounds: int = 12) -> DataFrame:
    """name, symbol: the symbol in use that each name stands for, from ``aliases(name, symbol, rank)``.

    A symbol that another one lists as previous has been renamed and is followed,
    over any chain of up to 2 ** ``rounds`` steps (each round doubles the steps that names have made). A
    name goes by its best rank: previous before alias; one that stands for several
    symbols there is ambiguous and has none, nor has one on a circle.
    """
    renamed = aliases.where("rank = 1 AND name <> symbol").select("name").distinct()
    # a symbol in use stands for itself, unless it was renamed
    held = aliases.where("rank = 0").join(renamed, "name", "left_anti").select("name").distinct()
    others = aliases.where("rank > 0 AND name <> symbol").join(held, "name", "left_anti")
    best = others.groupBy("name").agg(F.min("rank").alias("rank"))
    one = others.join(best, ["name", "rank"]).groupBy("name").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("symbol")).where("n = 1").drop("n")
    steps = written(one, "names")
    for _ in range(rounds):
        onward = steps.select(F.col("name").alias("symbol"), F.col("symbol").alias("next"))
        further = written(steps.join(onward, "symbol", "left").select("name", F.coalesce("next", "symbol").alias("symbol"), F.col("next").isNotNull().alias("moved")), "names")
        steps = further.drop("moved")
        if further.where("moved").isEmpty():
            break
    return held.select("name", F.col("name").alias("symbol")).unionByName(steps.join(held.select(F.col("name").alias("symbol")), "symbol", "left_semi").select("name", "symbol"))


def with_current_symbols(priors: DataFrame, current: DataFrame) -> DataFrame:
    """Relations with both ends under the symbols in use (``current_symbols``); ChEBI names stay, relations with another name go, those that become equal are merged."""
    out = priors
    for end in ("source", "target"):
        names = current.select(F.col("name").alias(end), F.col("symbol").alias("__symbol"))
        found = F.when(F.col(end).startswith("CHEBI:"), F.col(end)).otherwise(F.col("__symbol"))
        out = out.join(names, end, "left").withColumn(end, found).drop("__symbol").where(F.col(end).isNotNull())
    return merged([out.select(*priors.columns)])


def known_symbols(priors: DataFrame, symbols: DataFrame) -> DataFrame:
    """Relations whose ends are known gene symbols (column symbol) or ChEBI ids."""
    known = symbols.select(F.col("symbol")).distinct()
    out = priors
    for end in ("source", "target"):
        tagged = out.join(known.select(F.col("symbol").alias(end), F.lit(True).alias("__k")), end, "left")
        out = tagged.where(F.col("__k") | F.col(end).startswith("CHEBI:")).select(*priors.columns)
    return out


def neighborhood(priors: DataFrame, seeds: list[str]) -> DataFrame:
    return priors.where(F.col("source").isin(seeds) | F.col("target").isin(seeds))


def paths_between(priors: DataFrame, seeds: DataFrame) -> DataFrame:
    """Relations with both ends among ``seeds(gene)``."""
    s = seeds.select("gene").distinct()
    return priors.join(s, priors.source == s.gene, "left_semi").join(s, priors.target == s.gene, "left_semi")


def with_sign(priors: DataFrame) -> DataFrame:
    return priors.withColumn("rel_sign", rel_sign(F.col("rel_type")))


def recurrence(studies: DataFrame) -> DataFrame:
    """studies(study, source, rel_type, target) -> how many studies have each relation."""
    return studies.groupBy(*RELATION).agg(F.count_distinct("study").alias("n_studies"))


def recurrent_at_least(studies: DataFrame) -> DataFrame:
    """Cumulative graphs: each relation once for every level up to its number of studies."""
    return recurrence(studies).select(F.explode(F.sequence(F.lit(1), F.col("n_studies").cast("int"))).alias("at_least"), *RELATION)
