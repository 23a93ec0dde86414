"""Readers of measurement, prior, expression, mutation and activity files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import blank_to_null, log2, number
from ..model import RELATION, RELATION_TYPES, SITE_TYPES

NO_SITES = "cast(NULL AS array<struct<gene:string,aa:string,pos:int>>)"
#: Letters of the feature column.
FEATURES = {"P": "phosphoprotein", "G": "protein", "R": "rna", "A": "acetylprotein", "M": "methylprotein", "C": "metabolite"}


#: Order of lines that ``tsv`` reads.
LINE = "__line"


def with_line(read: DataFrame) -> DataFrame:
    """Rows as a file source gives them with LINE, which sorts them by file name and place in the file.

    A task reads the splits that Spark packs for it, largest first, so the order of
    tasks and splits is not that of lines. Within one split rows come in order.
    """
    return read.withColumn(LINE, F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place")))


def tsv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """All columns as text, without quoting, and LINE as the last one; short lines end in nulls."""
    return with_line(spark.read.option("sep", "\t").option("header", header).option("quote", "").option("mode", "PERMISSIVE").csv(path))


def line_of(table: DataFrame) -> Column:
    """LINE, or for tables that come from elsewhere the order in which Spark holds them."""
    return F.col(LINE) if LINE in table.columns else F.monotonically_increasing_id()


def tsv_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A tab-separated table, or None if there is no such file."""
    try:
        return tsv(spark, path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def need(df: DataFrame, columns: list[str]) -> None:
    if lost := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns not found: {lost}")


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def parse_site(text: Column) -> Column:
    """'S473' -> struct(aa, pos); null without a position."""
    return F.struct(F.upper(F.substring(text, 1, 1)).alias("aa"), F.regexp_extract(text, r"(\d+)", 1).try_cast("int").alias("pos"))


def annotation(table: DataFrame, id_column: str = "ID", symbols: str = "Symbols", sites: str = "Sites", effect: str = "Effect", feature: str | None = None) -> DataFrame:
    """Rows of a platform file.

    Genes are separated by white space, as are the site groups that belong to
    them; the sites of a group by a bar. Genes beyond the groups take those of
    the first. Effect a, i or else unknown; rows without sites have effect 1.
    Equal rows count once. Other rows with one id are all given:
    ``search.with_unique_ids`` refuses them, ``first_of_id`` takes the first (by ``line``).
    """
    need(table, [id_column, symbols, *([feature] if feature else [])])
    blank = lambda name: blank_to_null(_col(name)) if name and name in table.columns else F.lit(None).cast("string")
    rows = table.where(blank(id_column).isNotNull()).select(
        blank(id_column).alias("row_id"), F.split(blank(symbols), r"\s+").alias("genes"), F.split(blank(sites), r"\s+").alias("groups"),
        F.lower(F.substring(blank(effect), 1, 1)).alias("e"), F.upper(F.substring(blank(feature) if feature else F.lit(None).cast("string"), 1, 1)).alias("f"), line_of(table).alias("line"),
    )
    each = F.transform("genes", lambda g, i: F.transform(F.split(F.coalesce(F.try_element_at("groups", i + 1), F.try_element_at("groups", F.lit(1))), r"\|"), lambda s: F.struct(g.alias("gene"), parse_site(s)["aa"].alias("aa"), parse_site(s)["pos"].alias("pos"))))
    found = F.when(F.col("groups").isNotNull(), F.filter(F.flatten(each), lambda s: s["pos"].isNotNull()))
    types = F.create_map(*[F.lit(x) for kv in FEATURES.items() for x in kv])
    kind = F.coalesce(F.when(F.col("f").isNotNull(), types[F.col("f")]), F.when(F.col("groups").isNotNull(), "phosphoprotein").otherwise("protein"))
    known = F.when(F.col("e") == "a", 1).when(F.col("e") == "i", -1)
    made = rows.select("row_id", kind.alias("data_type"), "genes", found.alias("sites"), known.alias("known"), "line")
    site = F.col("data_type").isin(SITE_TYPES)
    made = made.withColumn("effect", F.when(site, F.coalesce("known", F.lit(0))).otherwise(F.coalesce("known", F.lit(1))))
    made = made.select("row_id", "data_type", "genes", F.when(site, F.col("sites")).alias("sites"), "effect", "line")
    return made.groupBy("row_id", "data_type", "genes", "sites", "effect").agg(F.min("line").alias("line"))


def first_of_id(rows: DataFrame) -> DataFrame:
    """Of each id the first line of an ``annotation``.

    Repeat experiments may name an id more than once. Values belong to ids, so such
    copies have one spread, and the rule that a larger spread wins leaves the first.
    """
    return rows.withColumn("n", F.row_number().over(W.partitionBy("row_id").orderBy("line"))).where("n = 1").drop("n", "line")


def values(table: DataFrame, id_column: str, columns: list[tuple[str, str]], replicate: int = 0) -> DataFrame:
    """Long values of ``columns`` (name, group); what is no number is missing. Of one id (without blanks around it) the last row counts."""
    need(table, [id_column, *(c for c, _ in columns)])
    numbered = table.withColumn(LINE, line_of(table))
    last = F.row_number().over(W.partitionBy(F.trim(_col(id_column))).orderBy(F.desc(LINE)))
    one = numbered.withColumn("__n", last).where("__n = 1")
    cells = F.array(*[F.struct(F.lit(i).alias("sample_idx"), F.lit(g).alias("grp"), number(_col(c)).alias("value")) for i, (c, g) in enumerate(columns)])
    return one.select(F.trim(_col(id_column)).alias("row_id"), F.lit(replicate).alias("replicate"), F.explode(cells).alias("x")).select("row_id", "replicate", "x.*")


def joined_values(rows: DataFrame, found: DataFrame, groups: list[str], missing: float | None = None, take_log: bool = False) -> DataFrame:
    """Values of the platform's rows; rows absent from the values file get ``missing`` (blank cells stay missing)."""
    ids = found.select("row_id").distinct().withColumn("__has", F.lit(True))
    absent = rows.select("row_id").join(ids, "row_id", "left_anti")
    cells = F.array(*[F.struct(F.lit(i).alias("sample_idx"), F.lit(g).alias("grp"), F.lit(missing).cast("double").alias("value")) for i, g in enumerate(groups)])
    filled = absent.select("row_id", F.lit(0).alias("replicate"), F.explode(cells).alias("x")).select("row_id", "replicate", "x.*")
    every = found.join(rows.select("row_id"), "row_id", "left_semi").unionByName(filled)
    return every.withColumn("value", log2(F.col("value"))) if take_log else every


def with_repeats(rows: DataFrame, found: DataFrame, again: DataFrame, values_again: DataFrame, take_log: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows and values after a repeat experiment: ids that ``rows`` has get more values, others become new rows."""
    fresh = again.join(rows.select("row_id"), "row_id", "left_anti")
    more = values_again.join(again.select("row_id"), "row_id", "left_semi")
    more = more.withColumn("value", log2(F.col("value"))) if take_log else more
    return rows.unionByName(fresh), found.unionByName(more)


def priors(spark: SparkSession, path: str) -> DataFrame:
    """source, type, target, mediators, sites in lines; comments and empty lines don't count; the first of equal relations holds. An unknown type is an error when read."""
    lines = with_line(spark.read.text(path)).withColumnRenamed(LINE, "line").where("value <> '' AND NOT startswith(value, '#')")
    part = lambda i: blank_to_null(F.try_element_at(F.split("value", "\t"), F.lit(i + 1)))
    sites = F.filter(F.transform(F.split(part(4), ";"), parse_site), lambda s: s["pos"].isNotNull())
    known = F.lower(part(1)).isin([t for t, _, _ in RELATION_TYPES])
    kind = F.when(known, F.lower(part(1))).otherwise(F.raise_error(F.concat(F.lit("unknown relation type: "), F.coalesce(part(1), F.lit("")))))
    rows = lines.select("line", part(0).alias("source"), kind.cast("string").alias("rel_type"), part(2).alias("target"), F.split(part(3), r"\s+").alias("mediators"), sites.alias("sites"))
    first = F.row_number().over(W.partitionBy(*RELATION).orderBy("line"))
    return rows.withColumn("n", first).where("n = 1").drop("n", "line")


def matrix(table: DataFrame, samples: list[tuple[str, str]], suffix: str, data_type: str, genes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A gene by sample matrix (first column the symbol): rows and values; only genes of ``genes(gene)`` if given."""
    symbol = table.columns[0]
    need(table, [s for s, _ in samples])
    kept = table.join(genes.select(F.col("gene").alias(symbol)).distinct(), symbol, "left_semi") if genes is not None else table
    kept = kept.where(_col(symbol).isNotNull()).withColumn("__id", F.concat(F.trim(_col(symbol)), F.lit(suffix)))
    rows = kept.select(F.col("__id").alias("row_id"), F.lit(data_type).alias("data_type"), F.array(F.trim(_col(symbol))).alias("genes"), F.expr(NO_SITES).alias("sites"), F.lit(1).alias("effect")).dropDuplicates(["row_id"])
    return rows, values(kept, "__id", samples)


def rna(spark: SparkSession, path: str, samples: list[tuple[str, str]], genes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return matrix(tsv(spark, path), samples, "-rna", "rna", genes)


def mutations(maf: DataFrame, effects: DataFrame, samples: list[tuple[str, str]], gene: str = "Hugo_Symbol", sample: str = "Tumor_Sample_Barcode") -> tuple[DataFrame, DataFrame]:
    """Mutated (1) or not (0) in each sample, for the genes of ``effects(gene, effect)`` only."""
    need(maf, [gene, sample])
    dim = maf.sparkSession.createDataFrame([(i, s, g) for i, (s, g) in enumerate(samples)], "sample_idx int, sample string, grp string")
    seen = maf.select(_col(gene).alias("gene"), _col(sample).alias("sample")).distinct().withColumn("hit", F.lit(1.0))
    cells = effects.select("gene").distinct().crossJoin(F.broadcast(dim))  # genes times the samples that were named
    vals = cells.join(seen, ["gene", "sample"], "left").select(F.concat("gene", F.lit("-mut")).alias("row_id"), F.lit(0).alias("replicate"), "sample_idx", "grp", F.coalesce("hit", F.lit(0.0)).alias("value"))
    rows = effects.select(F.concat("gene", F.lit("-mut")).alias("row_id"), F.lit("mutation").alias("data_type"), F.array("gene").alias("genes"), F.expr(NO_SITES).alias("sites"), F.col("effect").cast("int").alias("effect"))
    return rows, vals


def mutation_effects(spark: SparkSession, path: str) -> DataFrame:
    t = tsv(spark, path)
    return t.select(F.trim(_col(t.columns[0])).alias("gene"), _col(t.columns[1]).try_cast("int").alias("effect")).dropna()


def activity(spark: SparkSession, genes: list[tuple[str, str]], suffix: str = "") -> DataFrame:
    """Activity rows with their sign from (gene, a or i)."""
    made = [(f"{g}-{'active' if e == 'a' else 'inactive'}{suffix}", "activity", [g], None, 1, 1 if e == "a" else -1) for g, e in genes]
    return spark.createDataFrame(made, "row_id string, data_type string, genes array<string>, sites array<struct<gene:string,aa:string,pos:int>>, effect int, sign int")


def tf_activity(spark: SparkSession, path: str) -> DataFrame:
    """Lines 'symbol, activated | inhibited' after a header."""
    t = tsv(spark, path)
    up = F.lower(_col(t.columns[1])).startswith("a")
    gene = F.trim(_col(t.columns[0]))
    name = F.concat(gene, F.when(up, "-active-tf").otherwise("-inactive-tf"))
    return t.where(gene.isNotNull()).select(name.alias("row_id"), F.lit("activity").alias("data_type"), F.array(gene).alias("genes"), F.expr(NO_SITES).alias("sites"), F.lit(1).alias("effect"), F.when(up, 1).otherwise(-1).alias("sign"))


def activity_values(rows: DataFrame, n_samples: int = 1) -> DataFrame:
    cells = F.transform(F.sequence(F.lit(0), F.lit(n_samples - 1)), lambda i: i)
    return rows.select("row_id", F.lit(0).alias("replicate"), F.explode(cells).alias("sample_idx"), F.lit("all").alias("grp"), F.col("sign").cast("double").alias("value"))


def site_effects(spark: SparkSession, path: str) -> DataFrame:
    """gene, pos, effect from lines 'gene, site, effect (a, i, c)'."""
    t = tsv(spark, path)
    e = F.lower(F.substring(_col(t.columns[2]), 1, 1))
    return t.select(_col(t.columns[0]).alias("gene"), parse_site(_col(t.columns[1]))["pos"].alias("pos"), F.when(e == "a", 1).when(e == "i", -1).otherwise(0).alias("effect"))


def fill_effects(rows: DataFrame, effects: DataFrame, k: int = 0) -> DataFrame:
    """Give site rows of unknown effect that of the nearest known site of the gene within k residues; activating and inhibiting at once give 0.

    Positions are blocked by k + 1, so the near ones are found by equality.
    """
    unknown = rows.where(F.col("data_type").isin(SITE_TYPES) & (F.coalesce("effect", F.lit(0)) == 0)).select("row_id", F.explode("sites").alias("s")).select("row_id", "s.gene", "s.pos")
    block = lambda pos: F.floor(pos / F.lit(k + 1))
    near = unknown.withColumn("b", F.explode(F.array(block(F.col("pos")) - 1, block(F.col("pos")), block(F.col("pos")) + 1)))
    known = effects.where("effect <> 0").select("gene", F.col("pos").alias("kpos"), F.col("effect").alias("keffect"), block(F.col("pos")).alias("b"))
    found = near.join(known, ["gene", "b"]).withColumn("d", F.abs(F.col("pos") - F.col("kpos"))).where(F.col("d") <= k)
    nearest = found.withColumn("least", F.min("d").over(W.partitionBy("row_id", "gene", "pos"))).where("d = least")
    one = nearest.groupBy("row_id").agg(F.min("keffect").alias("low"), F.max("keffect").alias("high"))
    filled = one.select("row_id", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(0).alias("__e"))
    return rows.join(filled, "row_id", "left").withColumn("effect", F.coalesce("__e", "effect")).drop("__e").select(*rows.columns)


def significance(spark: SparkSession, path: str) -> tuple[DataFrame, float] | None:
    """A significance file: source with p_changed, p_activating and p_inhibiting (correlation mode: p), and the p of the graph's size. None if there is no such path."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    first = lines.where(F.col("value").startswith("Overall graph size pval")).first()
    names = lines.where(F.col("value").startswith("Gene\t")).first()
    if first is None or names is None:
        raise ValueError(f"not a significance file: {path}")
    columns = ["p"] if names.value.count("\t") == 1 else ["p_changed", "p_activating", "p_inhibiting"]
    part = F.split("value", "\t")
    rows = lines.where("value <> ''").where(~F.col("value").isin(first.value, names.value))
    found = rows.select(part[0].alias("source"), *(F.try_element_at(part, F.lit(i + 2)).try_cast("double").alias(c) for i, c in enumerate(columns)))
    return found, float(first.value.partition("=")[2])


def sif(spark: SparkSession, path: str) -> DataFrame:
    """source, rel_type, target, mediators, sites as text; single names have null type and target."""
    part = lambda i: blank_to_null(F.try_element_at(F.split("value", "\t"), F.lit(i + 1)))
    return spark.read.text(path).where("value <> ''").select(part(0).alias("source"), part(1).alias("rel_type"), part(2).alias("target"), part(3).alias("mediators"), part(4).alias("sites"))


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """gene, sequence from a FASTA file, of any number of lines a record; the first record of a gene holds.

    Records begin with ``>`` at the start of a line, and Spark splits files there, so a
    record is never cut. The gene is what GN= names in the heading, else its first word.
    """
    records = with_line(spark.read.option("lineSep", "\n>").text(path)).where(F.length(F.trim("value")) > 0)
    text = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(text, r"^([^\n\r]*)", 1)
    named = F.regexp_extract(head, r"\bGN=(\S+)", 1)
    gene = F.when(named != "", named).otherwise(F.regexp_extract(head, r"^\s*(\S+)", 1))
    letters = F.upper(F.regexp_replace(F.substring(text, F.length(head) + 1, F.length(text)), r"[^A-Za-z]", ""))
    found = records.select(gene.alias("gene"), letters.alias("sequence"), F.col(LINE).alias("line")).where("gene <> '' AND sequence <> ''")
    return found.groupBy("gene").agg(F.min_by("sequence", "line").alias("sequence"))


def kinase_weights(spark: SparkSession, path: str) -> DataFrame:
    """kinase, place, residue, weight: one line for each kinase and residue, the columns after those two are places from the site (-5 to 4)."""
    table = tsv(spark, path)
    kinase, residue, *places = [c for c in table.columns if c != LINE]
    cells = F.array(*[F.struct(F.lit(c).try_cast("int").alias("place"), number(_col(c)).alias("weight")) for c in places])
    return table.select(F.trim(_col(kinase)).alias("kinase"), F.trim(_col(residue)).alias("residue"), F.explode(cells).alias("x")).select("kinase", "x.place", "residue", "x.weight").dropna()


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """name, symbol, rank from a table of symbol, previous symbols and aliases (lists parted by commas or bars): 0 approved, 1 previous, 2 alias."""
    table = tsv(spark, path)
    names = [c for c in table.columns if c != LINE]
    symbol = F.trim(_col(names[0]))

    def ranked(column: Column, rank: int) -> Column:
        return F.transform(F.split(F.coalesce(column, F.lit("")), r"[,|]"), lambda x: F.struct(F.trim(x).alias("name"), F.lit(rank).alias("rank")))

    listed = F.concat(ranked(symbol, 0), *(ranked(_col(c), rank) for rank, c in enumerate(names[1:3], 1)))
    each = table.where(symbol.isNotNull()).select(symbol.alias("symbol"), F.explode(listed).alias("x"))
    return each.select("x.name", "symbol", "x.rank").where("name <> ''").distinct()


def format_lines(spark: SparkSession, path: str) -> DataFrame:
    """kind (node or edge), id, property, value."""
    part = lambda i: F.try_element_at(F.split("value", "\t"), F.lit(i + 1))
    return spark.read.text(path).where("value <> ''").select(part(0).alias("kind"), part(1).alias("id"), part(2).alias("property"), part(3).alias("setting"))
