"""A whole analysis: from parameters and files to result tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.multiple_testing import thresholds
from ..model import PROTEOMIC
from ..operators import correlation_blocks, detectors, fdr, kinase, pairwise, presence, priors, search, significance
from ..sources import params, sinks, tables


#: The parameter that asks for random presence tables, and how many are made: a p is at least one in so many.
RANDOM_TABLES, N_TABLES = "randomized-matrix-directory-for-missing-proteomic-data", 1000


@dataclass
class Analysis:
    """Inputs and results of one run; frames are lazy."""

    config: params.Config
    rows: DataFrame
    values: DataFrame
    priors: DataFrame
    changes: DataFrame | None = None
    pairs: DataFrame | None = None
    significance: DataFrame | None = None
    graph_p: float | None = None
    graph_sizes: DataFrame | None = None
    kinases: DataFrame | None = None
    reused: bool = False

    def result(self, causal: bool = True) -> DataFrame:
        found = search.satisfying(self.pairs, causal)
        if self.config.get("relation-filter-type") == "phospho-primary-expression-secondary":
            kept = priors.phospho_primary(search.relations(found))
            found = found.join(kept, ["source", "rel_type", "target"], "left_semi")
        return found


def _path(base: str, name: str) -> str:
    return name if "://" in name or name.startswith("/") else f"{base}/{name}"


def groups_of(config: params.Config) -> list[tuple[str, str]]:
    """(column, group) in order: control, test, then plain value columns."""
    return [
        *((c, "control") for c in config.get("control-value-column", [])),
        *((c, "test") for c in config.get("test-value-column", [])),
        *((c, "all") for c in config.get("value-column", [])),
    ]


def load(spark: SparkSession, base: str, config: params.Config) -> Analysis:
    """Read and combine the inputs that the parameters name. Missing files of a TCGA directory are skipped."""
    get = config.get
    columns = groups_of(config)
    groups = [g for _, g in columns]
    ids = get("id-column", "ID")
    values_file = tables.tsv(spark, _path(base, get("proteomics-values-file")))
    platform = tables.tsv(spark, _path(base, get("proteomics-platform-file"))) if get("proteomics-platform-file") else values_file
    rows = tables.annotation(platform, ids, get("symbols-column", "Symbols"), get("sites-column", "Sites"), get("effect-column", "Effect"), get("feature-column")).drop("line")
    values = tables.joined_values(rows, tables.values(values_file, ids, columns), groups, get("default-missing-value"), get("do-log-transform", False))
    for i, name in enumerate(get("proteomics-repeat-values-file", []), 1):
        repeat = tables.tsv(spark, _path(base, name))
        # a values file without symbols repeats the platform's rows alone
        named = tables.first_of_id(tables.annotation(repeat, ids, get("symbols-column", "Symbols"), get("sites-column", "Sites"), get("effect-column", "Effect"))) if get("symbols-column", "Symbols") in repeat.columns else rows
        rows, values = tables.with_repeats(rows, values, named, tables.values(repeat, ids, columns, i), get("do-log-transform", False))
    for key, kind in (("acetyl-proteomic-file", "acetylprotein"), ("methyl-proteomic-file", "methylprotein")):
        if get(key):
            more = tables.tsv(spark, _path(base, get(key)))
            extra = tables.annotation(more, ids, get("symbols-column", "Symbols"), get("sites-column", "Sites"), get("effect-column", "Effect")).withColumn("data_type", F.lit(kind)).drop("line")
            rows = rows.unionByName(extra)
            values = values.unionByName(tables.values(more, ids, columns))
    net = relations_of(spark, base, config)
    if get("rna-expression-file"):
        genes = net.select(F.explode(F.array("source", "target")).alias("gene")).distinct()
        r, v = tables.rna(spark, _path(base, get("rna-expression-file")), columns, genes)
        rows, values = rows.unionByName(r), values.unionByName(v)
    if get("tcga-directory"):
        folder = lambda name: _path(base, f"{get('tcga-directory')}/{name}")
        for name, suffix, kind in (("expression.txt", "-rna", "rna"), ("copynumber.txt", "-cna", "dna_cna"), ("rppa.txt", "-rppa", "protein")):
            if (table := tables.tsv_or_none(spark, folder(name))) is not None:
                r, v = tables.matrix(table, columns, suffix, kind)
                rows, values = rows.unionByName(r), values.unionByName(v)
        if get("mutation-effect-file") and (maf := tables.tsv_or_none(spark, folder("mutation.maf"))) is not None:
            effects = tables.mutation_effects(spark, _path(base, get("mutation-effect-file")))
            r, v = tables.mutations(maf, effects, columns)
            rows, values = rows.unionByName(r), values.unionByName(v)
    active = []
    if get("gene-activity"):
        active.append(tables.activity(spark, get("gene-activity")))
    if get("tf-activity-file"):
        active.append(tables.tf_activity(spark, _path(base, get("tf-activity-file"))))
    for found in active:
        rows = rows.unionByName(found.drop("sign"))
        values = values.unionByName(tables.activity_values(found, len(columns)))
    if get("custom-site-effects-file"):
        rows = tables.fill_effects(rows, tables.site_effects(spark, _path(base, get("custom-site-effects-file"))), get("site-effect-proximity-threshold", 0))
    rows = detectors.stdev_filter(rows, values, get("stdev-threshold-for-data", {}))
    return Analysis(config, search.with_unique_ids(rows), values, net)


def relations_of(spark: SparkSession, base: str, config: params.Config) -> DataFrame:
    """The prior relations that the parameters name, filtered."""
    get = config.get
    names = get("built-in-network-resource-selection", [])
    if get("custom-causal-priors-file"):
        net = tables.priors(spark, _path(base, get("custom-causal-priors-file")))
    elif names and get("custom-resource-directory"):
        net = priors.without_conflicts(priors.merged([tables.priors(spark, _path(base, f"{get('custom-resource-directory')}/{n}.sif")) for n in names]))
    else:
        raise ValueError("name custom-causal-priors-file, or networks and custom-resource-directory")
    more = [tables.priors(spark, _path(base, p)) for p in get("additional-custom-priors", [])]
    net = priors.with_additional(net, more) if more else net
    if get("hgnc-file"):
        net = priors.with_current_symbols(net, priors.current_symbols(tables.aliases(spark, _path(base, get("hgnc-file")))))
    return priors.gene_focus(priors.relation_filter(net, get("relation-filter-type", "no-filter")), get("gene-focus", []))


def correlation_limits(config: params.Config) -> pairwise.CorrelationLimits:
    get = config.get
    p = -1.0 if get("fdr-threshold-for-correlation") is not None else get("pval-threshold-for-correlation", -1.0)
    return pairwise.CorrelationLimits(get("correlation-value-threshold", 0.0), get("correlation-upper-threshold", 0.0), p, get("minimum-sample-size") or 3)


def run(analysis: Analysis, known: tuple[DataFrame, float] | None = None) -> Analysis:
    """Changes, search, false-discovery control and, if asked for, network significance.

    ``known`` is a network significance from an earlier run, used in place of new permutations.
    """
    get, rules = analysis.config.get, analysis.config.rules()
    mode = get("value-transformation", "as-is-single-value")
    if mode == "correlation":
        limits = correlation_limits(analysis.config)
        found = search.pairs(analysis.priors, analysis.rows, None, rules)
        ends = found.select(F.col("src_row").alias("a"), F.col("tgt_row").alias("b"))
        shown = detectors.presence(analysis.values, analysis.rows) if get("use-missing-proteomic-data-for-test", False) else None
        overlap = None
        if shown is not None and get(RANDOM_TABLES):
            proteomic = analysis.rows.where(F.col("data_type").isin(PROTEOMIC))
            state, samples = presence.randomised(shown, proteomic, N_TABLES)
            overlap = lambda e: presence.overlap_p(e, state, samples, shown, proteomic, N_TABLES)
        corr = pairwise.correlate(ends, analysis.rows, analysis.values, limits, shown, overlap)
        analysis.pairs = pairwise.correlation_pairs(found, corr).cache()
        signs_of = lambda e: pairwise.correlate(e, analysis.rows, analysis.values, limits, shown, overlap)
        if get("fdr-threshold-for-correlation") is not None:
            limit = fdr.correlation_threshold(analysis.pairs.where("verdict <> 0"), get("fdr-threshold-for-correlation"))
            signs_of = lambda e: pairwise.correlate(e, analysis.rows, analysis.values, limits, shown, overlap).where(F.col("p") <= limit)
            analysis.pairs = analysis.pairs.withColumn("verdict", F.when(F.col("corr_p") <= limit, F.col("verdict")).otherwise(0))
        if get("calculate-network-significance", False):
            dealt = significance.on_relations(analysis.priors, analysis.rows)
            limits = replace(limits, p=limit) if get("fdr-threshold-for-correlation") is not None else limits

            def test(n: int, least: int) -> tuple[DataFrame, float]:
                if shown is not None or not correlation_blocks.fits(dealt):
                    return significance.correlation_permutation_test(analysis.pairs, signs_of, dealt, n, minimum=least)
                out, graph_p, analysis.graph_sizes = correlation_blocks.permutation_test(analysis.pairs, analysis.values, dealt, limits, n, minimum=least)
                return out, graph_p

            _with_significance(analysis, known, test)
        return analysis
    rates = get("fdr-threshold-for-data-significance", {})
    limits = {**get("threshold-for-data-significance", {}), **{t: 1.0 for t in rates}}
    make = lambda by: detectors.changes(analysis.rows, analysis.values, mode, by, get("minimum-sample-size") or 0)
    if get("use-missing-proteomic-data-for-test", False) and mode.startswith("significant-change"):
        by_tables = None
        if get(RANDOM_TABLES):
            flags = detectors.presence(analysis.values, analysis.rows)
            state, samples = presence.randomised(flags, analysis.rows.where(F.col("data_type").isin(PROTEOMIC)), N_TABLES)
            by_tables = presence.missing_p(state, samples, flags, N_TABLES).select("row_id", "p")
        both = detectors.with_missing_value_test(analysis.values, analysis.rows, get("missing-value-test-data-sufficiency-threshold", 0.001), get("minimum-sample-size") or 0, mode.endswith("paired"), by_tables).cache()
        plain = make
        make = lambda by: _with_p(plain(by), both, analysis.rows, by)
    analysis.changes = make(limits).cache()
    analysis.pairs = search.pairs(analysis.priors, analysis.rows, analysis.changes, rules).cache()
    if rates:
        tested = fdr.participants(analysis.pairs.where("verdict <> 0")).where(F.col("data_type").isin([*rates, *PROTEOMIC]))
        ends = significance.on_relations(analysis.priors, analysis.rows).select("row_id", "data_type").join(analysis.changes.select("row_id", "p"), "row_id")
        limits.update(fdr.data_thresholds(tested, rates, get("pool-proteomics-for-fdr-adjustment", False), ends))
        analysis.changes = make(limits).cache()
        analysis.pairs = search.pairs(analysis.priors, analysis.rows, analysis.changes, rules).cache()
    if get("calculate-network-significance", False):
        dealt = significance.on_relations(analysis.priors, analysis.rows).select("row_id", "data_type").join(analysis.changes.select("row_id", "sign"), "row_id")
        targets = search.target_pairs(analysis.priors, search.by_gene(analysis.rows, analysis.changes), rules)
        _with_significance(analysis, known, lambda n, least: significance.permutation_test(targets, analysis.pairs, dealt, n, minimum=least))
        if get("use-network-significance-for-causal-reasoning", False):
            _with_network_activity(analysis, rules, get("fdr-threshold-for-network-significance", 0.1))
    return analysis


def _with_significance(analysis: Analysis, known: tuple[DataFrame, float] | None, test: Callable[[int, int], tuple[DataFrame, float]]) -> None:
    get = analysis.config.get
    analysis.reused = known is not None
    analysis.significance, analysis.graph_p = known or test(get("permutations-for-significance", 1000), get("minimum-potential-targets-to-consider-for-downstream-significance", 5))


def _with_p(changes: DataFrame, both: DataFrame, rows: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Replace value, p and sign of proteomic rows by those of the combined test."""
    from ..functions.scalars import sign_by_p

    joined = changes.join(rows.select("row_id", "data_type"), "row_id").join(both.select("row_id", F.col("value").alias("v2"), F.col("p").alias("p2")), "row_id", "left")
    limit = F.create_map(*[F.lit(x) for k, v in (limits or {"": 0.0}).items() for x in (k, float(v))])[F.col("data_type")]
    use = F.col("data_type").isin(PROTEOMIC)
    pick = lambda a, b: F.when(use, F.col(b)).otherwise(F.col(a))
    sign = F.when(use, F.coalesce(sign_by_p(F.col("v2"), F.col("p2"), limit), F.lit(0))).otherwise(F.col("sign"))
    return joined.select("row_id", pick("value", "v2").alias("value"), pick("p", "p2").alias("p"), sign.cast("int").alias("sign"))


def _significant(analysis: Analysis) -> DataFrame | None:
    """gene, crowded, activating, inhibiting: sources significant at the network's rate; None without a network significance."""
    sig = analysis.significance
    if sig is None:
        return None
    rate, out = analysis.config.get("fdr-threshold-for-network-significance", 0.1), [F.col("source").alias("gene")]
    names = {"p_changed": "crowded", "p_activating": "activating", "p_inhibiting": "inhibiting"} if "p_changed" in sig.columns else {"p": "crowded"}
    for column, name in names.items():
        limit = thresholds(sig.withColumn("all", F.lit(1)), ["all"], rate, column).agg(F.coalesce(F.max("threshold"), F.lit(-1.0))).first()[0]
        out.append((F.col(column) <= limit).alias(name))
    rest = [F.lit(False).alias(n) for n in ("activating", "inhibiting") if n not in names.values()]
    return sig.select(*out, *rest)


def _with_network_activity(analysis: Analysis, rules, rate: float) -> None:
    """Search again with sources that are significant downstream as activity rows."""
    sig, ok = analysis.significance, []
    for column in ("p_activating", "p_inhibiting"):
        limit = thresholds(sig.withColumn("all", F.lit(1)), ["all"], rate, column).agg(F.coalesce(F.max("threshold"), F.lit(-1.0))).first()[0]
        ok.append((F.coalesce(F.col(column) <= limit, F.lit(False))).alias(f"{column}_ok"))
    extra = significance.activity_rows(sig.select("source", *ok))
    rows = analysis.rows.unionByName(extra.drop("sign"))
    signs = extra.select("row_id", F.col("sign").cast("double").alias("value"), F.lit(None).cast("double").alias("p"), "sign")
    analysis.rows, analysis.changes = rows, analysis.changes.unionByName(signs).cache()
    analysis.pairs = search.pairs(analysis.priors, rows, analysis.changes, rules).cache()


def write(analysis: Analysis, out: str) -> None:
    """All result files as folders of tab-separated text under ``out``."""
    get = analysis.config.get
    by_p = get("value-transformation") in detectors.P_MODES
    for name, causal in (("causative", True), ("conflicting", False)):
        found = analysis.result(causal)
        kept = search.relations(found)
        correlation, unchanged = analysis.changes is None, get("show-insignificant-data", False)
        every = causal and not correlation and get("show-all-genes-with-proteomic-data", False)
        # of conflicts only the evidence is drawn, unless unchanged rows are shown too
        evidence = correlation or (get("hide-data-not-part-of-causal-relations", False) and not every if causal else not unchanged)
        genes, rows = sinks.drawn(found, analysis.priors, search.by_gene(analysis.rows, analysis.changes), every, unchanged or correlation, evidence)
        lines = sinks.formats(genes, rows, get("color-saturation-value", 1.0), _significant(analysis) if causal else None, not correlation)
        sinks.write_tsv(sinks.sif_lines(kept, analysis.priors).unionByName(sinks.isolated(genes, kept), allowMissingColumns=True), f"{out}/{name}.sif")
        sinks.write_tsv(lines, f"{out}/{name}.format")
        sinks.write_lines(sinks.graph_json(kept.join(analysis.priors, ["source", "rel_type", "target"]), lines).orderBy("kind", "json").select("json"), f"{out}/{name}.json")
        if analysis.config.get("generate-data-centric-graph", False):
            sinks.write_tsv(sinks.data_centric(found), f"{out}/{name}-data-centric.sif")
    sinks.write_tsv(sinks.results(analysis.result(), analysis.priors, by_p), f"{out}/results")
    if analysis.changes is not None and by_p:
        sinks.write_tsv(fdr.value_changes(analysis.rows, analysis.changes).orderBy("class", "p", "row_id"), f"{out}/value-changes")
        sinks.write_tsv(search.unknown_effects(analysis.priors, analysis.rows, analysis.changes, analysis.config.rules()).orderBy("site"), f"{out}/unknown-site-effects")
    if analysis.kinases is not None:
        signed = F.when(F.col("r") >= 0, F.col("p")).otherwise(-F.col("p"))
        sinks.write_tsv(analysis.kinases.orderBy("kinase").select(F.col("kinase").alias("Kinase"), signed.alias("pValues"), F.col("q").alias("QValue")), f"{out}/kinaseAnalysis")
    if analysis.significance is not None and not analysis.reused:
        sinks.write_lines(sinks.significance_lines(analysis.significance, analysis.graph_p), f"{out}/significance-pvals")
    if analysis.graph_sizes is not None:
        size = search.relations(search.satisfying(analysis.pairs)).count()
        sinks.write_lines(sinks.null_distribution_lines(size, analysis.graph_sizes), f"{out}/graph-size-null-dist")


def run_directory(spark: SparkSession, base: str, out: str | None = None) -> Analysis:
    """One analysis of a directory with parameters.txt.

    A network significance in the output folder is used again; remove it to
    run new permutations.
    """
    out = out or f"{base}/output"
    loaded = load(spark, base, params.read_parameters(spark, f"{base}/parameters.txt"))
    analysis = run(loaded, tables.significance(spark, f"{out}/significance-pvals"))
    if loaded.config.get("kinase-library", False):
        analysis.kinases = _kinases(spark, base, analysis)
    write(analysis, out)
    return analysis


def _kinases(spark: SparkSession, base: str, analysis: Analysis) -> DataFrame:
    """Kinase activity by the library that ``custom-resource-directory`` holds: kinase-library.tsv and sequences.fasta."""
    folder = analysis.config.get("custom-resource-directory")
    if not folder or analysis.changes is None:
        raise ValueError("kinase-library needs custom-resource-directory (kinase-library.tsv, sequences.fasta) and a mode with changes")
    weights = tables.kinase_weights(spark, _path(base, f"{folder}/kinase-library.tsv"))
    return kinase.library_activity(analysis.rows, analysis.changes, tables.sequences(spark, _path(base, f"{folder}/sequences.fasta")), weights)


def studies(spark: SparkSession, base: str) -> list[str]:
    """Directories with parameters.txt at any depth below ``base``, itself included, but none below another one."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "parameters.txt").load(base)
    every = sorted(r["path"].rpartition("/")[0] for r in found.select("path").collect())  # one path for each study
    kept: list[str] = []
    for path in every:
        if not any(path.startswith(f"{above}/") for above in kept):
            kept.append(path)
    return kept


def run_directories(spark: SparkSession, bases: list[str], threads: int = 4, one: Callable[[SparkSession, str], object] = run_directory) -> dict[str, str | None]:
    """Several analyses at once in one session, each in a scheduler pool of its own (fair, if spark.scheduler.mode says so).

    Gives what went wrong with each, None for those that ended well; a failed one doesn't stop the others.
    """

    def attempt(base: str) -> str | None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", base)
        try:
            one(spark, base)
        except Exception as error:  # noqa: BLE001  whatever it is, the others go on and it is reported
            return f"{type(error).__name__}: {error}"
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
        return None

    with ThreadPoolExecutor(threads) as pool:
        return dict(zip(bases, pool.map(attempt, bases), strict=True))


def run_recursive(spark: SparkSession, base: str, threads: int = 1) -> dict[str, str | None]:
    """``run_directories`` of all ``studies`` below a directory."""
    return run_directories(spark, studies(spark, base), threads)


def causality_graph(rows: DataFrame, values: DataFrame, net: DataFrame, threshold: float, graph_type: str = "causative", rules=None) -> DataFrame:
    """Library call: mean of each row against ``threshold`` (activity 0.1) -> relations; a type that begins with 'conflict' selects conflicts."""
    from ..model import Rules

    changes = detectors.changes(rows, values, "arithmetic-mean", {t: threshold for t in PROTEOMIC})
    found = search.pairs(net, rows, changes, rules or Rules())
    return search.relations(search.satisfying(found, not graph_type.startswith("conflict")))
