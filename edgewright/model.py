"""Tables and fixed dimensions.

rows      row_id, data_type, genes array<string>, sites array<struct<gene,aa,pos>>, effect int
values    row_id, replicate int, sample_idx int, grp string (control|test|all), value double (null: missing)
priors    source, rel_type, target, mediators array<string>, sites array<struct<aa,pos>>
changes   row_id, value double, p double, sign int
pairs     source, rel_type, target, rel_sign, and of either end: row, type, effect, value, p, sign
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "row_id string, data_type string, genes array<string>, sites array<struct<gene:string,aa:string,pos:int>>, effect int"
VALUES = "row_id string, replicate int, sample_idx int, grp string, value double"
PRIORS = "source string, rel_type string, target string, mediators array<string>, sites array<struct<aa:string,pos:int>>"
RELATION = ["source", "rel_type", "target"]

#: Type, sign, what kind of target it acts on.
RELATION_TYPES = [
    ("upregulates-expression", 1, "expression"),
    ("downregulates-expression", -1, "expression"),
    ("phosphorylates", 1, "phospho"),
    ("dephosphorylates", -1, "phospho"),
    ("acetylates", 1, "acetyl"),
    ("deacetylates", -1, "acetyl"),
    ("methylates", 1, "methyl"),
    ("demethylates", -1, "methyl"),
    ("activates-gtpase", 1, "gtpase"),
    ("inhibits-gtpase", -1, "gtpase"),
    ("produces", 1, "metabolite"),
    ("consumes", -1, "metabolite"),
    ("used-to-produce", 1, "metabolite"),
]
#: Types that count as acting on phosphorylation too, unless rules are strict.
ALSO_PHOSPHO = ["deacetylates", "demethylates"]
SITE_TYPES = ["phosphoprotein", "acetylprotein", "methylprotein"]
PROTEOMIC = ["protein", *SITE_TYPES]
EVIDENCE_TYPES = [*PROTEOMIC, "metabolite", "activity"]
DATA_TYPES = [*PROTEOMIC, "rna", "dna_cna", "dna_methylation", "mutation", "metabolite", "activity"]
TARGET_TYPE = {"phospho": ["phosphoprotein"], "gtpase": ["activity"], "acetyl": ["acetylprotein"], "methyl": ["methylprotein"], "metabolite": ["metabolite"]}


@dataclass(frozen=True)
class Rules:
    """How relations meet measurements."""

    site_proximity: int = 0
    force_site_match: bool = True
    expression_targets: tuple[str, ...] = ("protein",)
    strict_demod_types: bool = False
    prioritize_activity: bool = False
    strongest_per_gene: bool = False
    expression_as_evidence: bool = False
    activity_upstream_of_expression: bool = False
    general_activity_types: tuple[str, ...] = ()


def acts_on(rel_type: str, strict: bool = False) -> str:
    kind = next(k for t, _, k in RELATION_TYPES if t == rel_type)
    return "phospho" if rel_type in ALSO_PHOSPHO and not strict else kind


def relation_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RELATION_TYPES, "rel_type string, rel_sign int, kind string")


def rel_sign(rel_type: Column) -> Column:
    """1 or -1; null for an unknown type."""
    return F.when(rel_type.isin([t for t, s, _ in RELATION_TYPES if s > 0]), 1).when(rel_type.isin([t for t, s, _ in RELATION_TYPES if s < 0]), -1)


def target_rules(spark: SparkSession, rules: Rules) -> DataFrame:
    """(rel_type, rel_sign, tgt_type): 13 relation types times the data types that each can change."""
    found = []
    for name, sign, _ in RELATION_TYPES:
        kind = acts_on(name, rules.strict_demod_types)
        found += [(name, sign, t) for t in (rules.expression_targets if kind == "expression" else TARGET_TYPE[kind])]
    return spark.createDataFrame(found, "rel_type string, rel_sign int, tgt_type string")
