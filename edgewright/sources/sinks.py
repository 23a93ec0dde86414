"""Result tables and graph files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import color
from ..model import RELATION, SITE_TYPES
from ..operators.search import in_report_order, result_rows

#: Letters of data types in graph files.
LETTERS = {"phosphoprotein": "p", "acetylprotein": "a", "methylprotein": "m", "protein": "t", "metabolite": "c", "mutation": "x", "dna_cna": "d", "rna": "r", "dna_methylation": "h", "activity": "!"}


def site_text(sites: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(sites, lambda s: F.concat(F.coalesce(s["aa"], F.lit("")), s["pos"].cast("string")))), ";")


def results(found: DataFrame, priors: DataFrame, by_p: bool = True) -> DataFrame:
    """One line for each relation and pair, best relations first; pairs of correlation mode have its columns."""
    sites = priors.select(*RELATION, site_text(F.col("sites")).alias("Sites"))
    scored = result_rows(found, by_p).join(sites, RELATION, "left")
    letter = lambda e: F.when(F.col(e) > 0, "a").when(F.col(e) < 0, "i").otherwise("")
    if "corr_p" in found.columns:
        return in_report_order(scored).select(
            F.col("source").alias("Source"), F.col("rel_type").alias("Relation"), F.col("target").alias("Target"), "Sites",
            F.col("src_row").alias("Source data ID"), letter("src_effect").alias("Source site effect"), F.col("tgt_row").alias("Target data ID"),
            F.col("corr").alias("Correlation"), F.col("corr_p").alias("Correlation pval"),
        )
    return in_report_order(scored).select(
        F.col("source").alias("Source"), F.col("rel_type").alias("Relation"), F.col("target").alias("Target"), "Sites",
        F.col("src_row").alias("Source data ID"), F.col("src_type").alias("Source data type"), letter("src_effect").alias("Source site effect"), F.col("src_value").alias("Source change"), F.col("src_p").alias("Source change pval"),
        F.col("tgt_row").alias("Target data ID"), F.col("tgt_type").alias("Target data type"), F.col("tgt_value").alias("Target change"), F.col("tgt_p").alias("Target change pval"),
    )


def sif_lines(relations: DataFrame, priors: DataFrame) -> DataFrame:
    """source, type, target, mediators, sites of the relations of a result."""
    full = relations.select(*RELATION).distinct().join(priors, RELATION)
    return full.select(*RELATION, F.coalesce(F.array_join("mediators", " "), F.lit("")).alias("mediators"), F.coalesce(site_text(F.col("sites")), F.lit("")).alias("sites"))


def data_centric(found: DataFrame) -> DataFrame:
    """Edges between rows: every source row of a relation's evidence with every target row of it, also where that pair itself doesn't satisfy."""
    s, t = found.select(*RELATION, "src_row").distinct(), found.select(*RELATION, "tgt_row").distinct()
    return s.join(t, RELATION).select("src_row", "rel_type", "tgt_row").distinct()


#: Borders of nodes and marks.
DEFAULT_BORDER, ACTIVATING, INHIBITING, BOTH = "50 50 50", "0 180 20", "180 0 20", "150 150 0"


def formats(genes: DataFrame, data: DataFrame, saturation: float = 1.0, significant: DataFrame | None = None, background: bool = True) -> DataFrame:
    """kind, id, property, setting lines for ``genes(gene)`` from the rows to draw, data(gene, row_id, data_type, effect, value, sign).

    With ``background`` the first total-protein or metabolite row (by row_id) of a gene colours its node;
    other rows are marks: id|letter|colour|border|value. ``significant(gene, crowded,
    activating, inhibiting)``: genes whose targets are so get a broad or coloured border.
    """
    rows = data.join(genes.select("gene").distinct(), "gene", "left_semi")
    can_fill = F.col("data_type").isin("protein", "metabolite")
    first = F.row_number().over(W.partitionBy("gene").orderBy(F.when(can_fill, 0).otherwise(1), "row_id"))
    rows = rows.withColumn("n", first).withColumn("total", can_fill & (F.col("n") == 1) & F.lit(background))
    value = F.coalesce("value", F.lit(0.0))
    letters = F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])
    letter = F.when((F.col("data_type") == "activity") & (F.col("sign") < 0), "i").otherwise(letters[F.col("data_type")])
    by_effect = F.when(F.col("effect") > 0, ACTIVATING).when(F.col("effect") < 0, INHIBITING).otherwise(DEFAULT_BORDER)
    border = F.when(F.col("data_type").isin(SITE_TYPES), by_effect).when(F.col("data_type") == "mutation", F.when(F.col("effect") == 1, ACTIVATING).otherwise(INHIBITING)).when(F.col("data_type") == "activity", ACTIVATING).otherwise(DEFAULT_BORDER)
    mark = F.concat_ws("|", F.regexp_replace("row_id", r"\|", "-"), letter, color(value, saturation), border, F.round(value, 6).cast("string"))
    node = lambda prop, setting: [F.lit("node").alias("kind"), F.col("gene").alias("id"), F.lit(prop).alias("property"), setting.alias("setting")]
    out = data.sparkSession.createDataFrame([("node", "all-nodes", "color", "255 255 255"), ("node", "all-nodes", "bordercolor", DEFAULT_BORDER)], "kind string, id string, property string, setting string")
    # all lines of a row come from one look at it
    line = lambda prop, setting: F.struct(F.lit(prop).alias("property"), setting.alias("setting"))
    tooltip = F.concat_ws(", ", "row_id", F.round(value, 6).cast("string"))
    lines = F.when(F.col("total"), F.array(line("color", color(value, saturation)), line("tooltip", tooltip))).when(~F.col("total"), F.array(line("rppasite", mark)))
    parts = [rows.select(F.lit("node").alias("kind"), F.col("gene").alias("id"), F.inline(lines))]
    if significant is not None:
        drawn = significant.join(rows.select("gene").distinct(), "gene", "left_semi")
        hue = F.when(F.col("activating") & F.col("inhibiting"), BOTH).when(F.col("activating"), ACTIVATING).when(F.col("inhibiting"), INHIBITING)
        parts += [drawn.where("crowded").select(*node("borderwidth", F.lit("2"))), drawn.select(*node("bordercolor", hue)).where("setting IS NOT NULL")]
    for part in parts:
        out = out.unionByName(part)
    return out


def drawn(found: DataFrame, priors: DataFrame, data: DataFrame, every_gene: bool = False, unchanged: bool = False, evidence_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Genes and rows of a result's drawing, from all rows by gene, data(gene, row_id, sign, ...).

    Changed rows of the result's genes; with ``every_gene`` also genes elsewhere on
    relations that have a changed row, with all their rows (unchanged ones only with
    ``unchanged``); with ``evidence_only`` none but the rows of the result's pairs, changed or not if ``unchanged``.
    """
    genes = found.select(F.explode(F.array("source", "target")).alias("gene")).distinct()
    rows = data.join(genes, "gene", "left_semi")
    if evidence_only:
        used = found.select(F.explode(F.array("src_row", "tgt_row")).alias("row_id")).distinct()
        kept = rows.join(used, "row_id", "left_semi").select(*data.columns)
        return genes, kept if unchanged else kept.where("sign <> 0")
    rows = rows.where("sign <> 0")
    if every_gene:
        ends = priors.select(F.explode(F.array("source", "target")).alias("gene")).distinct()
        others = data.where("sign <> 0").select("gene").distinct().join(ends, "gene", "left_semi").join(genes, "gene", "left_anti")
        more = data.join(others, "gene", "left_semi").select(*data.columns)
        rows, genes = rows.unionByName(more if unchanged else more.where("sign <> 0")), genes.unionByName(others)
    return genes, rows


def isolated(genes: DataFrame, relations: DataFrame) -> DataFrame:
    """Genes of a drawing that no relation touches, as lines of a SIF file: the name alone."""
    ends = relations.select(F.explode(F.array("source", "target")).alias("gene")).distinct()
    return genes.join(ends, "gene", "left_anti").select(F.col("gene").alias("source"))


def _rgb(colour: Column) -> Column:
    return F.concat(F.lit("rgb("), F.regexp_replace(colour, " ", ","), F.lit(")"))


def graph_json(relations: DataFrame, formats: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """One JSON text for each node and each edge, from relations (with mediators and sites if they have them) and format lines.

    ``genes`` (gene), if at hand, are those at the relations' ends, so that these are not worked out for them once more.

    Nodes: data (id, text, sites, tooltipText) and css (backgroundColor,
    borderColor, borderWidth); edges: data (source, target, edgeType, tooltipText: the target's sites, pcLinks: mediators).
    """
    ends = relations.select(F.explode(F.array("source", "target")).alias("id")).distinct() if genes is None else genes.select(F.col("gene").alias("id"))
    one = lambda prop: F.max(F.when(F.col("property") == prop, F.col("setting")))
    part = F.split("setting", r"\|")
    site = F.struct(part[0].alias("siteInfo"), part[1].alias("siteText"), _rgb(part[2]).alias("siteBackgroundColor"), _rgb(part[3]).alias("siteBorderColor"))
    settings = formats.where("kind = 'node' AND id <> 'all-nodes'").groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.col("property") == "rppasite", site))).alias("sites"), one("tooltip").alias("tooltipText"), one("color").alias("fill"), one("bordercolor").alias("border"), one("borderwidth").alias("width"),
    )
    names = ends.unionByName(settings.select("id")).distinct()
    none = F.expr("cast(array() AS array<struct<siteInfo:string,siteText:string,siteBackgroundColor:string,siteBorderColor:string>>)")
    css = F.struct(_rgb(F.col("fill")).alias("backgroundColor"), _rgb(F.col("border")).alias("borderColor"), F.concat("width", F.lit("px")).alias("borderWidth"))
    has_css = F.coalesce("fill", "border", "width").isNotNull()
    data = F.struct("id", F.col("id").alias("text"), F.coalesce("sites", none).alias("sites"), "tooltipText")
    nodes = names.join(settings, "id", "left").select(F.lit("node").alias("kind"), F.to_json(F.struct(data.alias("data"), F.when(has_css, css).alias("css"))).alias("json"))
    sites = F.array_join(F.array_sort(F.transform("sites", lambda s: F.concat(F.col("target"), F.lit("_"), s["pos"].cast("string")))), ", ") if "sites" in relations.columns else F.lit("")
    links = F.when(F.size("mediators") > 0, F.col("mediators")) if "mediators" in relations.columns else F.lit(None).cast("array<string>")
    edge = F.struct("source", "target", F.col("rel_type").alias("edgeType"), F.coalesce(sites, F.lit("")).alias("tooltipText"), links.alias("pcLinks"))
    edges = relations.dropDuplicates(RELATION).select(F.lit("edge").alias("kind"), F.to_json(F.struct(edge.alias("data"))).alias("json"))
    return nodes.unionByName(edges)


def series(steps: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """steps(step, source, rel_type, target), marks(step, gene, row_id, colour) -> union of edges with the steps they are in; for every step a mark of every row, a ghost where it is missing."""
    edges = steps.groupBy(*RELATION).agg(F.array_sort(F.collect_set("step")).alias("steps"))
    names = marks.select("step").unionByName(steps.select("step")).distinct()
    every = marks.select("gene", "row_id").distinct().crossJoin(F.broadcast(names))  # rows times steps, of which there are a few
    full = every.join(marks, ["gene", "row_id", "step"], "left").withColumn("ghost", F.col("colour").isNull())
    return edges, full.withColumn("colour", F.coalesce("colour", F.lit("255 255 255")))


#: First line and column names of significance files, by p column.
GRAPH_SIZE = "Overall graph size pval = "
PVALS = {"p_changed": "Downstream crowded pval", "p_activating": "Downstream suggests activation pval", "p_inhibiting": "Downstream suggests inhibition pval", "p": "Downstream size pval"}


def significance_lines(found: DataFrame, graph_p: float) -> DataFrame:
    """``line`` in order: the p of the graph's size, names, then each source, the smallest p first."""
    columns = [c for c in PVALS if c in found.columns]
    head = f"{GRAPH_SIZE}{graph_p}\n" + "\t".join(["Gene", *(PVALS[c] for c in columns)])
    text = F.concat_ws("\t", "source", *(F.coalesce(F.col(c).cast("string"), F.lit("1.0")) for c in columns))
    rows = found.select(F.lit(1).alias("part"), F.array_min(F.array(*columns)).alias("least"), "source", text.alias("line"))
    first = found.sparkSession.createDataFrame([(0, None, None, head)], "part int, least double, source string, line string")
    return first.unionByName(rows).orderBy("part", F.asc_nulls_last("least"), "source").select("line")


def null_distribution_lines(size: int, sizes: DataFrame) -> DataFrame:
    """``line`` in order: the size of the result, then its size in each iteration of ``sizes(iter, size)``."""
    head = sizes.sparkSession.createDataFrame([(-1, f"Actual graph size\n{size}\n\nNull distribution")], "iter int, line string")
    return head.unionByName(sizes.select("iter", F.col("size").cast("double").cast("string").alias("line"))).orderBy("iter").select("line")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str, single: bool = True) -> None:
    """Tab-separated with a header; ``single`` writes one part, in the frame's order (reports of results, not of corpora)."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)
