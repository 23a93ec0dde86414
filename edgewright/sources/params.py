"""Parameter files and their keys."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..model import Rules

#: key -> (kind, may repeat, what it does). Kinds: text, list, number, int, flag, map (DATA-TYPE number), activity (GENE a|i).
KEYS: dict[str, tuple[str, bool, str]] = {
    "kinase-library": ("flag", False, "activity of kinases by the library in the resource directory"),
    "proteomics-values-file": ("text", False, "measurement values"),
    "proteomics-repeat-values-file": ("text", True, "values of a repeated experiment"),
    "proteomics-platform-file": ("text", False, "row annotation, if apart from the values"),
    "id-column": ("text", False, "column with row ids"),
    "symbols-column": ("text", False, "column with gene symbols"),
    "sites-column": ("text", False, "column with modification sites"),
    "feature-column": ("text", False, "column with the kind of modification (P, G, R, A, M, C)"),
    "effect-column": ("text", False, "column with the effect of the modification (a, i, c)"),
    "value-transformation": ("text", False, "how values become a change"),
    "value-column": ("text", True, "column with values"),
    "control-value-column": ("text", True, "column with values of control samples"),
    "test-value-column": ("text", True, "column with values of test samples"),
    "do-log-transform": ("flag", False, "take the logarithm to base 2 of values"),
    "rna-expression-file": ("text", False, "matrix of expression values"),
    "acetyl-proteomic-file": ("text", False, "values of acetylation sites"),
    "methyl-proteomic-file": ("text", False, "values of methylation sites"),
    "default-missing-value": ("number", False, "value of rows absent from the values file"),
    "tf-activity-file": ("text", False, "activities of transcription factors"),
    "gene-activity": ("activity", True, "a gene that is active (a) or inactive (i)"),
    "tcga-directory": ("text", False, "directory with copy number, expression, mutation and array files"),
    "mutation-effect-file": ("text", False, "effects of mutations by gene"),
    "hgnc-file": ("text", False, "known gene symbols"),
    "custom-causal-priors-file": ("text", False, "relations that replace built-in ones"),
    "additional-custom-priors": ("text", True, "relations to add"),
    "custom-site-effects-file": ("text", False, "effects of sites"),
    "custom-resource-directory": ("text", False, "where resource tables lie"),
    "built-in-network-resource-selection": ("list", True, "names of networks to use"),
    "threshold-for-data-significance": ("map", True, "limit by data type"),
    "fdr-threshold-for-data-significance": ("map", True, "false-discovery rate by data type"),
    "pool-proteomics-for-fdr-adjustment": ("flag", False, "treat proteomic types as one family"),
    "correlation-value-threshold": ("number", False, "least size of a correlation"),
    "correlation-upper-threshold": ("number", False, "largest size of a correlation"),
    "pval-threshold-for-correlation": ("number", False, "largest p of a correlation"),
    "fdr-threshold-for-correlation": ("number", False, "false-discovery rate of correlations"),
    "stdev-threshold-for-data": ("map", True, "least standard deviation by data type"),
    "minimum-sample-size": ("int", False, "least number of values in a group"),
    "calculate-network-significance": ("flag", False, "run the permutation test"),
    "permutations-for-significance": ("int", False, "number of permutations"),
    "fdr-threshold-for-network-significance": ("number", False, "false-discovery rate of sources"),
    "use-network-significance-for-causal-reasoning": ("flag", False, "add significant sources as activity"),
    "minimum-potential-targets-to-consider-for-downstream-significance": ("int", False, "least number of measured targets"),
    "use-missing-proteomic-data-for-test": ("flag", False, "test presence beside values"),
    "randomized-matrix-directory-for-missing-proteomic-data": ("text", False, "missing values are tested by randomised presence tables, made here whatever the directory"),
    "missing-value-test-data-sufficiency-threshold": ("number", False, "p that the margins must be able to reach"),
    "prioritize-activity-data": ("flag", False, "activity rows replace a gene's other evidence"),
    "do-site-matching": ("flag", False, "sites must match"),
    "site-match-proximity-threshold": ("int", False, "how far apart matching sites may lie"),
    "site-effect-proximity-threshold": ("int", False, "how far to look for a site's effect"),
    "relation-filter-type": ("text", False, "which relations to use"),
    "gene-focus": ("list", False, "genes that relations must touch"),
    "data-type-for-expressional-targets": ("text", True, "data types that expression relations change"),
    "use-strongest-proteomic-data-per-gene": ("flag", False, "one proteomic row for each gene"),
    "use-expression-for-activity-evidence": ("flag", False, "expression is evidence of activity"),
    "color-saturation-value": ("number", False, "value with the strongest colour"),
    "show-all-genes-with-proteomic-data": ("flag", False, "draw changed genes outside the result too"),
    "show-insignificant-data": ("flag", False, "draw unchanged rows"),
    "hide-data-not-part-of-causal-relations": ("flag", False, "draw evidence only"),
    "generate-data-centric-graph": ("flag", False, "nodes are rows"),
}
FILE_KEYS = {"do-site-matching": True}


@dataclass(frozen=True)
class Config:
    """Values by key; lists and maps for keys that repeat."""

    values: dict[str, object] = field(default_factory=dict)

    def get(self, key: str, default: object = None) -> object:
        if key not in KEYS:
            raise KeyError(f"unknown parameter: {key}")
        return self.values.get(key, FILE_KEYS.get(key, default))

    def rules(self) -> Rules:
        expression = [x.lower() for x in self.get("data-type-for-expressional-targets", [])]
        return Rules(
            site_proximity=self.get("site-match-proximity-threshold", 0),
            force_site_match=self.get("do-site-matching"),
            expression_targets=tuple(expression) or ("protein",),
            prioritize_activity=self.get("prioritize-activity-data", False),
            strongest_per_gene=self.get("use-strongest-proteomic-data-per-gene", False),
            expression_as_evidence=self.get("use-expression-for-activity-evidence", False),
        )


def _read(kind: str, text: str) -> object:
    if kind == "number":
        return float(text)
    if kind == "int":
        return int(text)
    if kind == "flag":
        if text.lower() not in ("true", "false"):
            raise ValueError(f"not true or false: {text}")
        return text.lower() == "true"
    if kind == "list":
        return [x for x in text.replace(",", ";").split(";") if x.strip()] if ";" in text or "," in text else text.split()
    if kind == "map":
        number, name = text.split()[0], " ".join(text.split()[1:])
        return (name.lower(), float(number))
    if kind == "activity":
        gene, what = text.split()
        if what not in ("a", "i"):
            raise ValueError(f"not a or i: {text}")
        return (gene, what)
    return text


def parse(lines: list[str]) -> Config:
    """Lines 'key = value', split at the first '='; lines of white space and those that start with # don't count. An unknown key, or one given twice that may not be, is an error."""
    out: dict[str, object] = {}
    for line in lines:
        if not line.strip() or line.startswith("#"):
            continue
        key, equals, text = (x.strip() for x in line.partition("="))
        if not equals or key not in KEYS:
            raise ValueError(f"unknown parameter: {line.strip()}")
        kind, repeats, _ = KEYS[key]
        value = _read(kind, text)
        if kind == "map":
            out.setdefault(key, {})[value[0]] = value[1]
        elif kind == "list":
            out[key] = [*out.get(key, []), *(x.strip() for x in value)]
        elif repeats:
            out.setdefault(key, []).append(value)
        else:
            out[key] = value
    return Config(out)


def read_parameters(spark: SparkSession, path: str) -> Config:
    """A parameter file from any store that Spark reads; a file of tens of lines."""
    return parse([r.value for r in spark.read.text(path).collect()])


def as_json() -> str:
    return json.dumps([{"id": k, "type": kind, "repeats": repeats, "about": about} for k, (kind, repeats, about) in KEYS.items()], indent=1)


def as_wiki() -> str:
    return "\n".join(f"* `{k}` ({kind}{', may repeat' if repeats else ''}): {about}." for k, (kind, repeats, about) in KEYS.items())
