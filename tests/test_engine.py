"""The causality engine on small hand-computed tables and against SQL."""

import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from edgewright.functions import stats
from edgewright.functions.multiple_testing import q_values, thresholds
from edgewright.model import PRIORS, ROWS, VALUES, Rules
from edgewright.operators import correlation_blocks, detectors, fdr, kinase, pairwise, priors, search, significance
from edgewright.plans import analysis, queries, tools
from edgewright.sources import params, sinks, tables

ROWS_T1 = [
    ("A_S10", "A", "S", 10, 1, 0.01), ("A_S20", "A", "S", 20, -1, 0.02), ("B_T5", "B", "T", 5, 0, 0.05),
    ("B_T9", "B", "T", 9, 0, -0.03), ("C_Y7", "C", "Y", 7, 0, 0.5), ("D", "D", None, None, 1, -0.001),
]
PRIORS_T1 = [("A", "phosphorylates", "B", "T", 5), ("A", "dephosphorylates", "B", "T", 9), ("A", "phosphorylates", "C", "Y", 7), ("A", "upregulates-expression", "D", None, None), ("D", "phosphorylates", "B", "T", 6)]


@pytest.fixture(scope="module")
def t1(spark):
    rows = spark.createDataFrame([(i, "phosphoprotein" if p else "protein", [g], [(g, a, p)] if p else None, e) for i, g, a, p, e, _ in ROWS_T1], ROWS)
    values = spark.createDataFrame([(i, 0, 0, "all", x) for i, *_, x in ROWS_T1], VALUES)
    net = spark.createDataFrame([(s, t, g, [], [(a, p)] if p else []) for s, t, g, a, p in PRIORS_T1], PRIORS)
    return rows, values, net


def found(t1, causal, **rules):
    rows, values, net = t1
    changes = detectors.changes(rows, values, "signed-p-values", {"protein": 0.1, "phosphoprotein": 0.1})
    return search.satisfying(search.pairs(net, rows, changes, Rules(**rules)), causal)


def edges(df):
    return {(r.source, r.rel_type, r.target, r.src_row, r.tgt_row) for r in df.collect()}


CAUSATIVE = {("A", "phosphorylates", "B", "A_S10", "B_T5"), ("A", "dephosphorylates", "B", "A_S10", "B_T9"), ("A", "upregulates-expression", "D", "A_S20", "D")}
CONFLICTING = {("A", "phosphorylates", "B", "A_S20", "B_T5"), ("A", "dephosphorylates", "B", "A_S20", "B_T9"), ("A", "upregulates-expression", "D", "A_S10", "D")}


def test_search(t1):
    assert edges(found(t1, True)) == edges(found(t1, True, site_proximity=1)) == CAUSATIVE
    assert edges(found(t1, False)) == CONFLICTING
    assert edges(found(t1, False, site_proximity=1)) == CONFLICTING | {("D", "phosphorylates", "B", "D", "B_T5")}


def test_result_order(t1):
    rows = sinks.results(found(t1, True), t1[2]).collect()
    assert [r["Relation"] for r in rows] == ["upregulates-expression", "dephosphorylates", "phosphorylates"]


def test_downstream_counts_and_filters(t1):
    rows, values, net = t1
    changes = detectors.changes(rows, values, "signed-p-values", {"protein": 0.1, "phosphoprotein": 0.1})
    targets = search.target_pairs(net, search.by_gene(rows, changes), Rules())
    a = {r.source: r for r in significance.downstream_counts(targets).collect()}["A"]
    assert (a.changed, a.activating, a.inhibiting) == (2, 1, 1)
    assert {r.source: r.potential for r in significance.potential(targets, 1).collect()} == {"A": 3}
    assert priors.relation_filter(net, "phospho-only").count() == 4
    assert {(r.source, r.target) for r in priors.gene_focus(net, ["D"]).collect()} == {("A", "D"), ("D", "B")}
    with pytest.raises(ValueError):
        priors.relation_filter(net, "nonsense")


def test_flipping_groups_flips_signs(spark):
    rng = np.random.default_rng(0)
    rows = [(f"r{i}", 0, j, "control" if j < 5 else "test", float(x)) for i in range(20) for j, x in enumerate(rng.normal(0, 1, 10))]
    values = spark.createDataFrame(rows, VALUES)
    other = values.withColumn("grp", F.when(F.col("grp") == "test", "control").otherwise("test"))
    a = {r.row_id: r.value for r in detectors.significant_change(values).collect()}
    b = {r.row_id: r.value for r in detectors.significant_change(other).collect()}
    assert all(a[k] == pytest.approx(-b[k]) for k in a)


def vals(spark, cells):
    return spark.createDataFrame([("r", 0, i, g, x) for i, (g, x) in enumerate(cells)], VALUES)


def test_detectors(spark):
    all_ = lambda *x: vals(spark, [("all", v) for v in x])
    one = lambda df: df.first()["value"]
    v = all_(1.0, 2.0, None, 4.0)
    assert one(detectors.arithmetic_mean(v)) == pytest.approx(7 / 3) and one(detectors.max_abs(v)) == 4 and one(detectors.first_value(v)) == 1
    assert one(detectors.max_abs(all_(-3.0, 3.0, None))) == -3 and one(detectors.max_abs(all_(None))) == 0
    assert one(detectors.geometric_mean(all_(2.0, -4.0, None))) == pytest.approx(-math.sqrt(2)) and one(detectors.geometric_mean(all_(-3.0))) == -3
    two = [("control", 1.0), ("control", 2.0), ("control", 3.0), ("test", 4.0), ("test", 5.0), ("test", 9.0)]
    w = vals(spark, two)
    assert one(detectors.difference_of_means(w)) == 4 and one(detectors.fold_change_of_mean(w)) == 3
    t = detectors.welch(w).first()
    assert (t.t, t.df) == (pytest.approx(2.449490, abs=1e-6), pytest.approx(2.56, abs=1e-2))
    s = detectors.significant_change(w).first()
    assert (s.p, s.value) == (pytest.approx(0.106367, abs=1e-6), pytest.approx(2.240863, abs=1e-5))
    assert detectors.significant_change(w, pairs=True).first().p == pytest.approx(0.057191, abs=1e-6)
    zero = detectors.changes(spark.createDataFrame([("r", "protein", ["G"], None, 1)], ROWS), all_(0.0), "as-is-single-value", {"protein": 0.0}).first()
    assert zero.sign == -1


def test_tail_probabilities(spark):
    t = spark.createDataFrame([(2.0, 5.0, 3.0)], "x double, a double, b double").select(
        stats.t_p(F.col("x"), F.col("a")).alias("t"), stats.chi2_p(F.lit(15.648092), F.lit(4.0)).alias("c"), stats.normal_p(F.lit(3.273606)).alias("n"),
        stats.f_p(F.col("x"), F.col("a"), F.col("b")).alias("f"), stats.z_of_p(F.lit(0.05)).alias("z"), stats.t_p(F.lit(None), F.lit(1.0)).alias("null"),
    ).first()
    assert t.t == pytest.approx(0.101939, abs=1e-5) and t.c == pytest.approx(0.003530, abs=1e-6) and t.n == pytest.approx(0.001062, abs=1e-6)
    assert t.f == pytest.approx(0.3013, abs=1e-3) and t.z == pytest.approx(1.959964, abs=1e-6) and t.null is None
    jvm = spark.sparkContext._jvm
    try:
        law = jvm.org.apache.commons.math3.distribution.TDistribution
        for df in (1.0, 2.5, 30.0, 400.0):
            for x in (0.0, 0.3, 2.0, 9.0):
                assert stats.t_two_sided(np.array([x]), np.array([df]))[0] == pytest.approx(2 * law(df).cumulativeProbability(-x), rel=1e-9)
    except TypeError:
        pytest.skip("no oracle on the class path")


def test_multiple_testing(spark):
    p = spark.createDataFrame([("a", x) for x in (0.001, 0.01, 0.02, 0.8)] + [("b", 0.9), ("b", None)], "f string, p double")
    assert {r.f: r.threshold for r in thresholds(p, ["f"], 0.05).collect()} == {"a": 0.02, "b": -1}
    q = {r.p: r.q for r in q_values(p, ["f"]).collect()}
    assert [round(q[x], 6) for x in (0.001, 0.01, 0.02, 0.8)] == [0.004, 0.02, 0.026667, 0.8] and q[None] is None


def test_combinations(spark):
    tests = spark.createDataFrame([("r", 1.0, 0.01), ("r", 2.0, 0.04)], "row_id string, diff double, p double")
    s = detectors.combine_repeats(tests).first()
    assert s.p == pytest.approx(0.001062, abs=1e-5) and s.diff == 1.5
    f = detectors.fisher(tests.where("p < 0.02"), tests.where("p > 0.02")).first()
    assert f.p == pytest.approx(0.003530, abs=1e-5)
    cells = [("test", 1.0)] * 8 + [("control", 1.0)] * 2 + [("test", 0.0)] * 3 + [("control", 0.0)] * 7
    g = detectors.contingency(vals(spark, cells)).first()
    assert g.g == pytest.approx(5.300218, abs=1e-5)
    assert detectors.categorical_change(vals(spark, cells)).first().p == pytest.approx(0.021323, abs=1e-5)


def test_correlation(spark):
    rows = spark.createDataFrame([(r, "protein", [r], None, 1) for r in "ab"], ROWS)
    values = spark.createDataFrame([(r, 0, i, "all", float(x)) for r, xs in (("a", [1, 2, 3, 4, 5]), ("b", [2, 1, 4, 3, 5])) for i, x in enumerate(xs)], VALUES)
    got = pairwise.correlate(spark.createDataFrame([("a", "b")], "a string, b string"), rows, values).first()
    assert got.r == pytest.approx(0.8) and got.p == pytest.approx(0.104088, abs=1e-6) and got.sign == 1


def test_conflicts(spark):
    pm = lambda n: [f"PMID:{i}" for i in range(n)]
    net = spark.createDataFrame(
        [("A", "phosphorylates", "B", pm(3), [("S", 1), ("S", 2)]), ("A", "dephosphorylates", "B", pm(1), [("S", 2), ("S", 3)]), ("C", "phosphorylates", "B", pm(2), [("S", 1)]), ("C", "dephosphorylates", "B", pm(2), [("S", 1)]), ("A", "upregulates-expression", "D", pm(2), []), ("A", "downregulates-expression", "D", pm(1), [])],
        PRIORS,
    )
    got = {(r.source, r.rel_type, r.target): [s.pos for s in r.sites] for r in priors.without_conflicts(net).collect()}
    assert got == {("A", "phosphorylates", "B"): [1, 2], ("A", "dephosphorylates", "B"): [3], ("C", "phosphorylates", "B"): [], ("C", "dephosphorylates", "B"): [], ("A", "upregulates-expression", "D"): []}


def _network(spark):
    net = [(f"G{s}", "phosphorylates", f"T{t}", 1 if t % 4 else -1, f"g{s}", 1 if s else -1, f"t{t}") for s in range(3) for t in range(s, 12)]
    pairs = spark.createDataFrame(net, "source string, rel_type string, target string, rel_sign int, src_row string, src_effect int, tgt_row string")
    rows = [(f"g{s}", "protein", s - 1) for s in range(3)] + [(f"t{t}", "phosphoprotein", 1 if t < 5 else -1 if t < 7 else 0) for t in range(12)]
    return net, pairs, rows, spark.createDataFrame(rows, "row_id string, data_type string, sign int")


def _targets(spark, net):
    return spark.createDataFrame([(s, k, t, r, tr) for s, k, t, r, _, _, tr in net], "source string, rel_type string, target string, rel_sign int, tgt_row string")


def test_permutations_are_repeatable_and_bounded(spark):
    net, pairs, _, frame = _network(spark)
    runs = [significance.permutation_test(_targets(spark, net), pairs, f, 20) for f in (frame, frame.repartition(5))]
    first, second = (sorted(map(tuple, r[0].collect())) for r in runs)
    assert first == second and runs[0][1] == runs[1][1]
    for r in runs[0][0].collect():
        assert all(0.05 <= p <= 1 for p in (r.p_changed, r.p_activating, r.p_inhibiting))


def _deals(frame, n, seed=1):
    """The signs that each iteration deals, as dictionaries."""
    words = -(-n // significance.BATCH)
    masks = significance.dealt_signs(significance.slots(frame), 0, words, seed).collect()
    bit = lambda m, i: m[i // significance.BATCH] >> i % significance.BATCH & 1
    return [{r.row_id: bit(r.up, i) - bit(r.down, i) for r in masks} for i in range(n)]


def _downstream(net, sign, sources):
    of = {g: [len({t for s, _, t, r, _, _, tr in net if s == g and hit(sign[tr] * r, sign[tr])}) for hit in (lambda x, y: y != 0, lambda x, y: x == 1, lambda x, y: x == -1)] for g in sources}
    return of, len({(s, k, t) for s, k, t, r, sr, e, tr in net if sr and sign[sr] * sign[tr] * r * e == 1})


@pytest.mark.parametrize("causal", [True, False])
def test_permutation_test_against_counts_by_hand(spark, causal):
    net, pairs, rows, frame = _network(spark)
    # H has no data of its own; K's targets never change; the last row is on no relation and is not dealt
    extra = [("H", "upregulates-expression", f"T{t}", -1, None, 0, f"t{t}") for t in range(6)] + [("K", "upregulates-expression", f"Z{t}", 1, None, 0, f"z{t}") for t in range(5)]
    still = [(f"z{t}", "metabolite", 0) for t in range(5)]
    frame = frame.unionByName(spark.createDataFrame(still, frame.schema))
    every, n = net + extra, 300
    dealt = _deals(frame, n)
    kinds = {r: k for r, k, _ in rows + still}
    deck = lambda of: sorted((kinds[r], v) for r, v in of.items())
    truth = {r: v for r, _, v in rows + still}
    assert all(deck(d) == deck(truth) for d in dealt) and len({tuple(sorted(d.items())) for d in dealt}) > 290
    turned = every if causal else [(s, k, t, r, sr, -e, tr) for s, k, t, r, sr, e, tr in every]
    sources = ("G0", "G1", "G2", "H", "K")
    seen, _ = _downstream(every, truth, sources)
    size = _downstream(turned, truth, sources)[1]
    drawn = [(_downstream(every, d, sources)[0], _downstream(turned, d, sources)[1]) for d in dealt]
    got, graph_p = significance.permutation_test(_targets(spark, every), pairs, frame, n, causal=causal, settled=None)
    assert graph_p == sum(d[1] >= size for d in drawn) / n and size > 0
    rows_of = {r.source: r for r in got.collect()}
    assert set(rows_of) == set(sources)
    for source, r in rows_of.items():
        want = [max(1, sum(d[0][source][i] >= o for d in drawn)) / n if o else 1.0 for i, o in enumerate(seen[source])]
        assert [r.changed, r.activating, r.inhibiting] == seen[source] and [r.p_changed, r.p_activating, r.p_inhibiting] == want and r.iterations == (n if any(seen[source]) else 0)
    # sources whose p is settled leave early, with the same p within its error
    quick, quick_p = significance.permutation_test(_targets(spark, every), pairs, frame, n, causal=causal, settled=15)
    for r in quick.collect():
        full = rows_of[r.source]
        assert r.iterations <= n and (r.source != "K" or r.iterations == 0)
        for c in significance.TESTS:
            assert abs(r[f"p_{c}"] - full[f"p_{c}"]) < 0.15
    assert min(r.iterations for r in quick.collect() if r.source != "K") < n and abs(quick_p - graph_p) < 0.15


def test_only_rows_on_relations_are_dealt(t1):
    rows, _, net = t1
    more = rows.unionByName(rows.where("row_id = 'D'").withColumns({"row_id": F.lit("far"), "genes": F.array(F.lit("Q"))}))
    assert {r.row_id for r in significance.on_relations(net, more).collect()} == {r[0] for r in ROWS_T1}


def test_correlation_permutations_against_counts_by_hand(spark, monkeypatch):
    rng = np.random.default_rng(4)
    names = [f"g{i}" for i in range(3)] + [f"t{i}" for i in range(9)]
    kind = lambda r: "protein" if r[0] == "g" else "phosphoprotein"
    data = {r: rng.normal(0, 1, 10) for r in names}
    for i in range(4):
        data[f"t{i}"] = data["g0"] * (1 if i % 2 else -1) + rng.normal(0, 0.3, 10)
    data["t8"] = np.full(10, 2.0)  # no variance
    for r in names:
        data[r][rng.random(10) < 0.1] = np.nan
    data["t7"][2:] = np.nan  # too few values
    net = [(f"G{g}", "upregulates-expression", f"T{t}", 1 if (g + t) % 3 else -1, f"g{g}", 1 if g else -1, f"t{t}") for g in range(3) for t in range(9) if (g * 5 + t) % 4 or g == 0]
    net += [("G0", "phosphorylates", "T1", -1, "g0", -1, "t1"), ("G2", "upregulates-expression", "T1", 1, "g1", 1, "t3")]
    rows = spark.createDataFrame([(r, kind(r), [r.upper()], None, 1) for r in names], ROWS)
    values = spark.createDataFrame([(r, 0, i, "all", None if np.isnan(x) else float(x)) for r in names for i, x in enumerate(data[r])], VALUES)
    limits = pairwise.CorrelationLimits(p=0.2)
    every = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    sign = {(r.a, r.b): r.sign for r in pairwise.correlate(every, rows, values, limits).collect()}
    found = spark.createDataFrame(net, "source string, rel_type string, target string, rel_sign int, src_row string, src_effect int, tgt_row string")
    found = found.join(spark.createDataFrame([(a, b, s) for (a, b), s in sign.items()], "src_row string, tgt_row string, s int"), ["src_row", "tgt_row"]).withColumn("verdict", F.expr("s * rel_sign * src_effect"))
    n, where = 200, {r: (r.kind, r.slot, r.n) for r in significance.slots(rows.withColumn("sign", F.lit(0))).collect()}
    at, holder = {r.row_id: v for r, v in where.items()}, {(v[0], v[1]): r.row_id for r, v in where.items()}

    def result(sign_of):
        kept = {(s, k, t) for s, k, t, r, sr, e, tr in net if sign_of(sr, tr) * r * e == 1}
        return {g: len({t for s, _, t in kept if s == g}) for g in ("G0", "G1", "G2")}, len(kept)

    seen, size = result(lambda a, b: sign.get((a, b), 0))
    drawn = []
    for i in range(n):
        to = {r: holder[k, int(significance.permuted(np.array([x]), m, hash((int(k), 1, i)))[0])] for r, (k, x, m) in at.items()}
        drawn.append(result(lambda a, b: sign.get((to[a], to[b]), 0)))
    monkeypatch.setattr(correlation_blocks, "BLOCK", 4)
    monkeypatch.setattr(correlation_blocks, "LOOKUPS", 64 * len(net))
    out, graph_p, sizes = correlation_blocks.permutation_test(found, values, rows, limits, n)
    assert [r["size"] for r in sizes.orderBy("iter").collect()] == [d[1] for d in drawn] and graph_p == sum(d[1] >= size for d in drawn) / n
    assert {r.source: (r.n, r.p) for r in out.collect()} == {g: (seen[g], max(1, sum(d[0][g] >= seen[g] for d in drawn)) / n if seen[g] else 1.0) for g in seen}
    # the way for any kind of data gives the same
    signs = lambda e: pairwise.correlate(e, rows, values, limits)
    slow, slow_p = significance.correlation_permutation_test(found, signs, rows, 20)
    assert slow_p == sum(d[1] >= size for d in drawn[:20]) / 20
    assert {r.source: r.p for r in slow.collect()} == {g: max(1, sum(d[0][g] >= seen[g] for d in drawn[:20])) / 20 if seen[g] else 1.0 for g in seen}


def test_types_without_tested_rows_go_by_all_rows_on_relations(spark):
    schema = "row_id string, data_type string, p double"
    tested = spark.createDataFrame([("a", "protein", 0.001), ("b", "protein", 0.9)], schema)
    others = spark.createDataFrame([("a", "protein", 0.001)] + [(f"r{i}", "rna", 0.001 if i < 2 else 0.5 + i / 100) for i in range(10)], schema)
    assert fdr.data_thresholds(tested, {"protein": 0.1, "rna": 0.1, "metabolite": 0.1}, others=others) == {"protein": 0.001, "rna": 0.001, "metabolite": 1.0}
    assert fdr.data_thresholds(tested, {"rna": 0.1}, others=others.where("p > 0.1")) == {"rna": -1.0}


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permuted_is_a_fair_bijection(n):
    slot = np.arange(n)
    places = [significance.permuted(slot, n, key) for key in range(400)]
    assert all(sorted(p.tolist()) == list(range(n)) for p in places)
    assert n == 1 or abs(np.mean([p[0] for p in places]) - (n - 1) / 2) < n / 6 and abs(np.mean([p[0] < p[n // 2] for p in places]) - 0.5) < 0.12


def test_sequence_windows(spark):
    seq = spark.createDataFrame([("A", "MKLVSTPQRSAWYG" * 3), ("B", "MKLVSTPQRSAWYG" * 3), ("C", "G" * 50)], "gene string, sequence string")
    sites = lambda *s: [(g, "S", p) for g, p in s]
    rows = spark.createDataFrame(
        [("one", "phosphoprotein", ["A"], sites(("A", 10)), 0), ("two", "phosphoprotein", ["A"], sites(("A", 10), ("A", 24)), 0), ("same", "phosphoprotein", ["A", "B"], sites(("A", 10), ("B", 10)), 0), ("differ", "phosphoprotein", ["A", "C"], sites(("A", 10), ("C", 10)), 0), ("total", "protein", ["A"], None, 1), ("edge", "phosphoprotein", ["A"], sites(("A", 2)), 0)],
        ROWS,
    )
    got = {r.row_id: r.window for r in kinase.sequence_windows(rows, seq).collect()}
    assert got == {"one": "STPQRSAWYG", "same": "STPQRSAWYG"}


def test_parameters():
    c = params.parse(["# note", "", "value-transformation = signed-p-values", "threshold-for-data-significance = 0.1 protein", "threshold-for-data-significance = 0.2 phosphoprotein", "value-column = a", "value-column = b", "gene-activity = TP53 a", "do-site-matching = false", "gene-focus = A;B"])
    assert c.get("threshold-for-data-significance") == {"protein": 0.1, "phosphoprotein": 0.2} and c.get("value-column") == ["a", "b"]
    assert c.get("gene-activity") == [("TP53", "a")] and c.rules().force_site_match is False and c.get("gene-focus") == ["A", "B"]
    with pytest.raises(ValueError):
        params.parse(["no-such-key = 1"])
    assert len(params.KEYS) >= 57 and "value-column" in params.as_json() + params.as_wiki()


def test_run_from_files(spark, tmp_path):
    lines = ["ID\tSymbols\tSites\tEffect\tSignedP"]
    for i, g, a, p, e, x in ROWS_T1:
        lines.append("\t".join([i, g, f"{a}{p}" if p else "", {1: "a", -1: "i", 0: ""}[e] if p else "", str(x)]))
    (tmp_path / "data.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "priors.txt").write_text("# priors\n" + "\n".join("\t".join([s, t, g, "", f"{a}{p}" if p else ""]) for s, t, g, a, p in PRIORS_T1) + "\nA\tphosphorylates\tB\t\tT99\n")
    (tmp_path / "parameters.txt").write_text("proteomics-values-file = data.txt\nid-column = ID\nvalue-column = SignedP\nvalue-transformation = signed-p-values\nthreshold-for-data-significance = 0.1 phosphoprotein\nthreshold-for-data-significance = 0.1 protein\ncustom-causal-priors-file = priors.txt\n")
    done = analysis.run_directory(spark, str(tmp_path), str(tmp_path / "out"))
    assert edges(done.result()) == CAUSATIVE and edges(done.result(False)) == CONFLICTING
    sif = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out/causative.sif")).collect()
    assert {(r.source, r.rel_type, r.target, r.sites) for r in sif} == {("A", "phosphorylates", "B", "T5"), ("A", "dephosphorylates", "B", "T9"), ("A", "upregulates-expression", "D", None)}
    assert (tmp_path / "out/results").exists() and (tmp_path / "out/value-changes").exists()


def test_significance_is_used_again(spark, tmp_path):
    assert tables.significance(spark, str(tmp_path / "none")) is None
    found = spark.createDataFrame([("A", 0.5, None, 0.01), ("B", 0.001, 1.0, 1.0)], "source string, p_changed double, p_activating double, p_inhibiting double")
    sinks.write_lines(sinks.significance_lines(found, 0.25), str(tmp_path / "pvals"))
    again, graph_p = tables.significance(spark, str(tmp_path / "pvals"))
    assert graph_p == 0.25 and [tuple(r) for r in again.collect()] == [("B", 0.001, 1.0, 1.0), ("A", 0.5, 1.0, 0.01)]
    single = spark.createDataFrame([("A", 0.5)], "source string, p double")
    sinks.write_lines(sinks.significance_lines(single, 0.0), str(tmp_path / "one"))
    assert [tuple(r) for r in tables.significance(spark, str(tmp_path / "one"))[0].collect()] == [("A", 0.5)]


def test_correlation_run_with_permutations(spark, tmp_path):
    names = [f"s{i}" for i in range(8)]
    base = [1.0, 4.0, 2.0, 8.0, 5.0, 7.0, 3.0, 6.0]
    lines = ["\t".join(["ID", "Symbols", "Sites", "Effect", *names])]
    lines.append("\t".join(["A", "A", "", "", *map(str, base)]))
    for t in range(6):
        own = [x + 0.1 * ((i * (t + 2)) % 3) for i, x in enumerate(base)]
        lines.append("\t".join([f"T{t}", f"T{t}", "", "", *map(str, own)]))
    (tmp_path / "data.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "priors.txt").write_text("".join(f"A\tupregulates-expression\tT{t}\n" for t in range(6)))
    keys = ["proteomics-values-file = data.txt", "id-column = ID", "value-transformation = correlation", "pval-threshold-for-correlation = 0.05", "custom-causal-priors-file = priors.txt", "calculate-network-significance = true", "permutations-for-significance = 10"]
    (tmp_path / "parameters.txt").write_text("\n".join([*keys, *(f"value-column = {n}" for n in names)]) + "\n")
    done = analysis.run_directory(spark, str(tmp_path))
    assert {r.target for r in done.result().collect()} == {f"T{t}" for t in range(6)}
    got = done.significance.collect()
    assert [(r.source, r.n) for r in got] == [("A", 6)] and got[0].p == 1.0 and done.graph_p == 1.0  # every row follows every other, so permutations change nothing
    again = analysis.run_directory(spark, str(tmp_path))
    assert again.reused and [tuple(r) for r in again.significance.collect()] == [("A", 1.0)]


def test_views_of_graphs(spark, tmp_path):
    for name, extra in (("early", ""), ("late", "B\tphosphorylates\tC\t\tS3\n")):
        where = tmp_path / "runs" / name / "deep"
        where.mkdir(parents=True)
        (where / "causative.sif").write_text("A\tphosphorylates\tB\t\tS1\n" + extra + "Lonely\n")
        (where / "causative.format").write_text("node\tall-nodes\tcolor\t255 255 255\nnode\tB\trppasite\tB_S1|p|1 2 3|0 0 0|0.5\n" + ("node\tC\trppasite\tC_S3|p|4 5 6|0 0 0|1\nedge\tB phosphorylates C\tcolor\t0 0 0\n" if extra else ""))
    stems = tools.graphs_below(spark, str(tmp_path / "runs"))
    assert [s.rsplit("/", 3)[1:] for s in stems] == [["early", "deep", "causative"], ["late", "deep", "causative"]]
    assert tools.step_names(stems) == ["early", "late"] and tools.step_names(["x"]) == ["x"]
    edge, marks = tools.series_view(spark, stems)
    assert {(r.source, r.target): list(r.steps) for r in edge.collect()} == {("A", "B"): ["early", "late"], ("B", "C"): ["late"]}
    assert {(r.step, r.row_id, r.ghost) for r in marks.collect()} == {("early", "B_S1", False), ("late", "B_S1", False), ("early", "C_S3", True), ("late", "C_S3", False)}
    assert tools.jsonize(spark, str(tmp_path / "runs")) == stems
    texts = [json.loads(r.value) for r in spark.read.text(f"{stems[1]}.json").collect()]
    data = [t["data"] for t in texts]
    assert {d["id"] for d in data if "id" in d} == {"A", "B", "C"} and {(d["source"], d["edgeType"], d["target"], d["tooltipText"]) for d in data if "source" in d} == {("A", "phosphorylates", "B", "B_1"), ("B", "phosphorylates", "C", "C_3")}
    assert next(d for d in data if d.get("id") == "C")["sites"] == [{"siteInfo": "C_S3", "siteText": "p", "siteBackgroundColor": "rgb(4,5,6)", "siteBorderColor": "rgb(0,0,0)"}]
    sif, lines = tables.sif(spark, f"{stems[1]}.sif"), tables.format_lines(spark, f"{stems[1]}.format")
    kept, shown = tools.graph_view(sif, lines, ["C"])
    assert [(r.source, r.target) for r in kept.collect()] == [("B", "C")] and {r.id for r in shown.collect()} == {"all-nodes", "B", "C", "B phosphorylates C"}
    assert [(r.source, r.target) for r in tools.graph_view(sif, lines)[0].collect()] == [("B", "C")]
    with pytest.raises(ValueError):
        tools.series_view(spark, [])


def test_effects_nearby(spark):
    rows = spark.createDataFrame([("a", "phosphoprotein", ["G"], [("G", "S", 10)], 0), ("b", "phosphoprotein", ["G"], [("G", "S", 30)], 0)], ROWS)
    known = spark.createDataFrame([("G", 12, -1), ("G", 14, 1)], "gene string, pos int, effect int")
    assert {r.row_id: r.effect for r in tables.fill_effects(rows, known, 3).collect()} == {"a": -1, "b": 0}
    assert {r.row_id: r.effect for r in tables.fill_effects(rows, known, 1).collect()} == {"a": 0, "b": 0}


@pytest.mark.parametrize("name", ["causative_relations", "conflicting_relations", "search_pairs_near_sites", "downstream_counts", "network_without_conflicts", "welch_t", "fdr_q_values", "spearman_correlation", "change_significant", "change_signed_p", "correlation_signs", "additional_priors", "merged_networks", "relations_of_known_symbols", "activity_upstream_of_expression", "evidence_of_expression"])
def test_star_queries_match_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in queries.QUERIES[name](spark, sf).collect()) == want


def test_tail_probabilities_converge_for_many_degrees_of_freedom():
    import numpy as np

    from edgewright.functions import stats

    half = [float(stats.gamma_upper(np.array([k / 2]), np.array([k / 2]))[0]) for k in (1e5, 1e6, 1e7)]
    assert all(0.499 < x < 0.5 for x in half) and half == sorted(half)
    assert abs(float(stats.beta_inc(np.array([3.0]), np.array([2.0]), np.array([0.7]))[0]) - 0.6517) < 1e-9
    assert abs(float(stats.t_two_sided(np.array([4.0]), np.array([2.0]))[0]) - 0.057191) < 1e-6


def test_mutation_rows_are_tested_by_their_categories(spark):
    from edgewright.model import ROWS, VALUES
    from edgewright.operators import detectors

    rows = spark.createDataFrame([("m", "mutation", ["A"], None, 1), ("x", "protein", ["B"], None, 1)], ROWS)
    hits = (1, 10, 11, 12, 13, 14, 15, 16, 17)
    cells = [("m", 0, i, "control" if i < 10 else "test", float(i in hits)) for i in range(20)]
    cells += [("x", 0, i, "control" if i < 3 else "test", float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 9])]
    got = {r.row_id: (round(r.p, 6), r.sign) for r in detectors.changes(rows, spark.createDataFrame(cells, VALUES), "significant-change-of-mean", {"mutation": 0.1, "protein": 0.2}).collect()}
    assert got == {"m": (0.000903, 1), "x": (0.106367, 1)}


def test_repeats_bring_new_rows_and_ids_are_trimmed_and_unique(spark):
    import pytest

    from edgewright.model import ROWS
    from edgewright.operators import search
    from edgewright.sources import tables

    first = spark.createDataFrame([("x", "1"), ("x ", "2")], "ID string, v string")
    assert [r.value for r in tables.values(first, "ID", [("v", "all")]).collect()] in ([1.0], [2.0])
    rows = spark.createDataFrame([("x", "protein", ["A"], None, 1)], ROWS)
    again = spark.createDataFrame([("x", "protein", ["A"], None, 1), ("new", "protein", ["B"], None, 1)], ROWS)
    values = tables.values(first, "ID", [("v", "all")])
    more = tables.values(spark.createDataFrame([("x", "5"), ("new", "6")], "ID string, v string"), "ID", [("v", "all")], 1)
    r, v = tables.with_repeats(rows, values, again, more)
    assert sorted(x.row_id for x in r.collect()) == ["new", "x"] and sorted((x.row_id, x.replicate) for x in v.collect()) == [("new", 1), ("x", 0), ("x", 1)]
    assert search.with_unique_ids(r).count() == 2
    with pytest.raises(ValueError, match="A x"):
        search.with_unique_ids(rows.unionByName(rows))


def test_repeated_ids_of_a_platform_are_an_error(spark, tmp_path):
    (tmp_path / "p.txt").write_text("ID\tSymbols\tSites\tEffect\tv\nx\tA\tS1\ta\t1\nx\tA\tS1\ta\t1\ny\tA\tS2\ti\t2\n")
    made = tables.annotation(tables.tsv(spark, str(tmp_path / "p.txt")))
    assert search.with_unique_ids(made).count() == 2  # equal lines count once
    (tmp_path / "q.txt").write_text("ID\tSymbols\tSites\tEffect\tv\nx\tA\tS2\ti\t7\nx\tA\tS1\ta\t1\nz\tB\t\t\t1\nz\tC\t\t\t1\n")
    made = tables.annotation(tables.tsv(spark, str(tmp_path / "q.txt")))
    with pytest.raises(ValueError, match="A x"):
        search.with_unique_ids(made.where("row_id = 'x'"))
    with pytest.raises(ValueError, match="B C z"):
        search.with_unique_ids(made.where("row_id = 'z'"))
    assert [(r.row_id, r.sites[0].pos) for r in tables.first_of_id(made.where("row_id = 'x'")).collect()] == [("x", 2)]


def test_order_of_lines_holds_for_many_files_and_splits(spark, tmp_path):
    for part in range(3):
        lines = [f"id{i % 40}\t{1000 * part + i}" for i in range(200)]
        (tmp_path / f"part-{part}.txt").write_text("ID\tv\n" + "\n".join(lines) + "\n")
        net = [f"A{i % 40}\tphosphorylates\tB\tPMID:{1000 * part + i}" for i in range(200 + 300 * (2 - part))]
        (tmp_path / f"net-{part}.sif").write_text("\n".join(net) + "\n")
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    held = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        table = tables.tsv(spark, str(tmp_path / "part-*.txt"))
        assert table.rdd.getNumPartitions() > 10
        last = {r.row_id: r.value for r in tables.values(table, "ID", [("v", "all")]).collect()}
        assert last == {f"id{i % 40}": float(2000 + i) for i in range(160, 200)}
        first = {r.source: r.mediators for r in tables.priors(spark, str(tmp_path / "net-*.sif")).collect()}
        assert first == {f"A{i}": [f"PMID:{i}"] for i in range(40)}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
