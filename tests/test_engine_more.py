"""Random tables, robustness, kinase library, names, mutation comparison and directory runs on small tables."""

import itertools
import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from edgewright.functions import stats
from edgewright.model import PRIORS, ROWS, VALUES, Rules
from edgewright.operators import detectors, kinase, pairwise, presence, priors, search, significance
from edgewright.plans import analysis, queries
from edgewright.sources import sinks, tables


def table_of(cells, width, n_tables):
    return np.unpackbits(np.frombuffer(cells, np.uint8), count=width * n_tables).reshape(n_tables, width)


def flags_of(spark, matrix, groups, kind="protein"):
    rows = spark.createDataFrame([(f"r{i}", kind, [f"R{i}"], None, 1) for i in range(len(matrix))], ROWS)
    cells = [(f"r{i}", 0, j, groups[j], None if x is None else float(x)) for i, row in enumerate(matrix) for j, x in enumerate(row)]
    return rows, spark.createDataFrame(cells, VALUES)


def test_random_tables_keep_sums(spark):
    rng = np.random.default_rng(3)
    full = (rng.random((150, 20)) < 0.6).astype(int)
    rows, flags = flags_of(spark, full.tolist(), ["control", "test"] * 10)
    state, samples = presence.randomised(flags, rows, tables=30, rounds=4)
    got = {r.row_id: table_of(r.cells, 20, 30) for r in state.collect()}
    assert samples == list(range(20)) and len(got) == 150
    cube = np.stack([got[f"r{i}"] for i in range(150)], 1)
    assert (cube.sum(2) == full.sum(1)[None]).all() and (cube.sum(1) == full.sum(0)[None]).all()
    assert (cube != full[None]).mean() > 0.3 and len({m.tobytes() for m in cube}) == 30


def test_random_tables_against_all_tables_of_the_same_sums(spark):
    """4 x 4: p of missing values and of overlaps against full enumeration."""
    matrix = [[1, 1, 0, 0], [0, 1, 1, 0], [1, 0, 1, 0], [1, 1, 1, 1]]
    groups, n = ["control", "control", "test", "test"], 4000
    rows, flags = flags_of(spark, matrix, groups)
    m = np.array(matrix)
    every = [t for t in (np.array(x).reshape(4, 4) for x in itertools.product((0, 1), repeat=16)) if (t.sum(0) == m.sum(0)).all() and (t.sum(1) == m.sum(1)).all()]
    two = lambda counts, o: min(1.0, max(1 / n, 2 * min(np.mean(np.array(counts) >= o), np.mean(np.array(counts) <= o))))
    state, samples = presence.randomised(flags, rows, tables=n, rounds=8)
    for r in presence.missing_p(state, samples, flags, n).collect():
        i = int(r.row_id[1])
        assert r.observed == (m[i, 2:] == 0).sum()
        assert abs(r.p - two([(t[i, 2:] == 0).sum() for t in every], r.observed)) < 0.05
    pairs = spark.createDataFrame([(f"r{i}", f"r{j}") for i in range(4) for j in range(i)], "a string, b string")
    for r in presence.overlap_p(pairs, state, samples, flags, rows, n).collect():
        i, j = int(r.a[1]), int(r.b[1])
        assert r.overlap == (m[i] == m[j]).sum()
        assert abs(r.p - two([(t[i] == t[j]).sum() for t in every], r.overlap)) < 0.05


def test_all_pairs_of_a_block_trade_in_one_call():
    """Sums of rows and samples stay, samples that a row takes no part in stay as they are, and every sharing out comes up alike."""
    cells = np.repeat(np.array([[1, 1, 0, 0, 0, 1], [0, 0, 1, 0, 1, 0], [1, 0, 1, 1, 0, 0], [0, 1, 0, 0, 1, 1]], bool)[:, None], 30000, 1)
    known = np.array([[1, 1, 1, 1, 1, 0], [1, 1, 1, 1, 1, 1], [1, 1, 1, 1, 1, 1], [1, 1, 1, 1, 1, 1]], bool)
    before = cells.copy()
    presence._trade(cells, known, np.array([0, 2]), np.array([1, 3]), np.random.default_rng(4))
    assert (cells.sum(2) == before.sum(2)).all() and (cells[:2].sum(0) == before[:2].sum(0)).all() and (cells[2:].sum(0) == before[2:].sum(0)).all()
    assert (cells[:2, :, 5] == before[:2, :, 5]).all() and (cells[:2, :, 3] == before[:2, :, 3]).all()
    for row, ways in ((0, 6), (2, 20)):
        found, n = np.unique(cells[row], axis=0, return_counts=True)
        assert len(found) == ways and np.abs(n * ways / 30000 - 1).max() < 0.15


def test_samples_in_which_a_type_is_not_measured_take_no_part(spark):
    rows, flags = flags_of(spark, [[1, 0, None, 1], [0, 1, None, 0], [1, 1, None, 0]], ["control", "test", "test", "test"])
    state, samples = presence.randomised(flags, rows, tables=20, rounds=2)
    assert all(not table_of(r.cells, 4, 20)[:, 2].any() for r in state.collect())
    assert {r.observed for r in presence.missing_p(state, samples, flags, 20).collect()} == {1}
    empty = presence.randomised(flags.where("false"), rows, tables=5, rounds=1)[0]
    assert empty.count() == 0


@pytest.mark.parametrize("cumulative,rates", [(True, None), (False, None), (True, {"protein": 0.3})])
def test_robustness_equals_a_search_for_each_iteration(spark, cumulative, rates):
    rng = np.random.default_rng(6)
    names = [f"g{i}" for i in range(3)] + [f"t{i}" for i in range(8)]
    rows = spark.createDataFrame([(r, "protein", [r.upper()], None, -1 if r == "g1" else 1) for r in names], ROWS)
    cells = [(r, 0, i, "test" if i > 3 else "control", float(rng.normal(1.5 * (i > 3) * (k % 3 - 1), 0.4))) for k, r in enumerate(names) for i in range(8)]
    values = spark.createDataFrame([*cells, ("t7", 0, 8, "test", None)], VALUES)
    net = spark.createDataFrame([(f"G{g}", "upregulates-expression" if (g + t) % 2 else "downregulates-expression", f"T{t}", [], []) for g in range(3) for t in range(8)], PRIORS)
    change = lambda r, v: detectors.changes(r, v, "significant-change-of-mean", {"protein": 1.0 if rates else 0.1})
    n, sd = 3, 0.5
    got = {r["iter"]: (r.overlap, r.novel, r.lost) for r in significance.robustness(net, rows, values, change, sd, n, cumulative=cumulative, rates=rates).collect()}
    noisy = significance.with_noise(values, sd, n, cumulative=cumulative)

    def bh(p):
        p = sorted(p)
        return max([x for k, x in enumerate(p, 1) if x <= rates["protein"] * k / len(p)], default=-1)

    def result(v, tested):
        changes = change(rows, v)
        if rates:
            limit = bh([r.p for r in changes.collect() if r.row_id in tested and r.p is not None])
            changes = changes.withColumn("sign", F.when(F.col("p") <= limit, F.col("sign")).otherwise(0))
        return {tuple(r) for r in search.relations(search.satisfying(search.pairs(net, rows, changes))).collect()}

    both = search.pairs(net, rows, change(rows, values)).where("verdict <> 0").collect()
    tested = {r.src_row for r in both} | {r.tgt_row for r in both}
    base = result(values, tested)
    for i in range(n):
        other = result(noisy.where(F.col("iter") == i).drop("iter"), tested)
        assert got[i] == (len(base & other), len(other - base), len(base - other))
    assert len(got) == n and base


def test_noise_is_normal_and_repeatable(spark):
    values = spark.range(4000).select(F.col("id").cast("string").alias("row_id"), F.lit(0).alias("replicate"), F.lit(0).alias("sample_idx"), F.lit("all").alias("grp"), F.lit(1.0).alias("value"))
    a = significance.with_noise(values, 2.0, 3, cumulative=False)
    x = np.array([r.value for r in a.collect()])
    assert abs(x.mean() - 1) < 0.1 and abs(x.std() - 2) < 0.1
    steps = significance.with_noise(values, 2.0, 3).where("iter = 2").agg(F.stddev("value")).first()[0]
    assert abs(steps - 2 * math.sqrt(3)) < 0.2
    again = significance.with_noise(values.repartition(7), 2.0, 3, cumulative=False)
    assert a.exceptAll(again).isEmpty()


#: The cases of sequence windows: one protein with one site (STAT3, YAP1), one with several (MAP2K1), several with several (MAPK1, MAPK3), several with one each that differ (AKT1-3), another modification.
def sequence_case(spark, tmp_path):
    seq = {g: "".join(chr(65 + (i * 7 + k * 11) % 25) for i in range(40)) for k, g in enumerate(["STAT3", "YAP1", "MAP2K1", "MAPK1", "MAPK3", "AKT1", "AKT2", "AKT3", "SAME1", "SAME2"])}
    seq["SAME2"] = seq["SAME1"]
    text = ""
    for i, (g, s) in enumerate(seq.items()):
        text += f">sp|Q{i}|{g}_X some > protein OX=1 GN={g} PE=1\n" + "\n".join(s[k : k + 7] for k in range(0, 40, 7)) + "\n"
    text += ">YAP1 another of one gene\r\nAAAA\r\nCCCC\r\n>EMPTY\n"
    (tmp_path / "sequences.fasta").write_text(text)
    site = lambda *gs: [(g, "S", p) for g, p in gs]
    data = [
        ("i1", "phosphoprotein", site(("STAT3", 20)), -2.445136194872271), ("i2", "phosphoprotein", site(("MAP2K1", 10), ("MAP2K1", 11)), -0.27898862494155197),
        ("i3", "phosphoprotein", site(("MAPK1", 12), ("MAPK1", 14), ("MAPK3", 12), ("MAPK3", 15)), -0.619769844905208), ("i4", "phosphoprotein", site(("AKT2", 18), ("AKT1", 17), ("AKT3", 16)), 7.619689476352495),
        ("i5", "phosphoprotein", site(("YAP1", 17)), 8.024169754065225), ("i6", "acetylprotein", site(("STAT3", 25)), 0.0), ("i7", "phosphoprotein", site(("STAT3", 38)), 1.0), ("i8", "phosphoprotein", site(("SAME1", 9), ("SAME2", 9)), 3.0),
    ]
    rows = spark.createDataFrame([(i, k, sorted({g for g, _, _ in s}), s, 1) for i, k, s, _ in data], ROWS)
    changes = spark.createDataFrame([(i, v, None, 0) for i, _, _, v in data], "row_id string, value double, p double, sign int")
    return rows, changes, seq


def test_sequences_and_their_order_by_change(spark, tmp_path):
    rows, changes, seq = sequence_case(spark, tmp_path)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "64"):  # records are whole however small the splits are
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = tables.sequences(spark, str(tmp_path / "sequences.fasta"))
            assert {r.gene: r.sequence for r in found.collect()} == seq
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    got = [(r.window, r.value) for r in kinase.sequences_by_change(rows, changes, found).collect()]
    around = lambda g, p: seq[g][p - 6 : p + 4]
    assert got == [(around("STAT3", 20), -2.445136194872271), (around("SAME1", 9), 3.0), (around("YAP1", 17), 8.024169754065225)]


def test_kinase_scores_by_hand_and_in_a_run(spark, tmp_path):
    rows, _, seq = sequence_case(spark, tmp_path)
    (tmp_path / "kinase-library.tsv").write_text("KINASE\tAA\t-5\t0\t4\nK1\tA\t2\t4\t8\nK1\tB\t0.5\t1\t1\nK2\tA\t1\tx\t0\n")
    weights = tables.kinase_weights(spark, str(tmp_path / "kinase-library.tsv"))
    assert {(r.kinase, r.place, r.residue, r.weight) for r in weights.collect()} == {("K1", -5, "A", 2.0), ("K1", 0, "A", 4.0), ("K1", 4, "A", 8.0), ("K1", -5, "B", 0.5), ("K1", 0, "B", 1.0), ("K1", 4, "B", 1.0), ("K2", -5, "A", 1.0), ("K2", 4, "A", 0.0)}
    windows = spark.createDataFrame([("AxxxxAxxxA",), ("BxxxxBxxxX",), ("xxxxxxxxxx",)], "window string")
    assert {(r.window, r.kinase, r.score) for r in kinase.window_scores(windows, weights).collect()} == {("AxxxxAxxxA", "K1", 6.0), ("AxxxxAxxxA", "K2", 0.0), ("BxxxxBxxxX", "K1", -1.0)}
    # a run: scores fall with the change of the windows
    sites, lib = [("STAT3", 20), ("YAP1", 17), ("MAPK1", 12), ("SAME1", 9), ("AKT1", 17)], {}
    lines = ["ID\tSymbols\tSites\tEffect\tv"]
    for k, (g, p) in enumerate(sites):
        lines.append(f"{g}-{p}\t{g}\tS{p}\ta\t{k + 1}")
        lib[seq[g][p - 1]] = 2.0 ** -(k + 1)
    (tmp_path / "data.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "kinase-library.tsv").write_text("KINASE\tAA\t0\n" + "".join(f"K\t{a}\t{w}\n" for a, w in lib.items()))
    (tmp_path / "priors.txt").write_text("STAT3\tphosphorylates\tYAP1\t\tS17\n")
    (tmp_path / "parameters.txt").write_text("proteomics-values-file = data.txt\nid-column = ID\nvalue-column = v\nvalue-transformation = arithmetic-mean\nthreshold-for-data-significance = 1 phosphoprotein\ncustom-causal-priors-file = priors.txt\ncustom-resource-directory = .\nkinase-library = true\n")
    done = analysis.run_directory(spark, str(tmp_path))
    one = done.kinases.collect()
    assert len(lib) == 5 and [(r.kinase, r.n, round(r.r, 9)) for r in one] == [("K", 5, -1.0)]
    written = next((tmp_path / "output" / "kinaseAnalysis").glob("part-*")).read_text().splitlines()
    assert written[0] == "Kinase\tpValues\tQValue" and written[1].startswith("K\t-0.0")


def test_mutation_comparison_by_hand(spark):
    rng = np.random.default_rng(8)
    names = ["s1", "s2", "t1", "t2", "t3"]
    rows = spark.createDataFrame([(r, "protein", [r.upper()], None, 1) for r in names], ROWS)
    data = {r: rng.normal(0, 1, 12) for r in names}
    mutated = {"A": [i < 6 for i in range(12)], "B": [i % 2 == 0 for i in range(12)]}
    for r in ("s1", "t1"):
        data[r][:6] += 5
    data["t2"][:6] -= 5
    values = spark.createDataFrame([(r, 0, i, "all", float(x)) for r in names for i, x in enumerate(data[r])], VALUES)
    groups = spark.createDataFrame([(g, i, "test" if m else "control") for g, ms in mutated.items() for i, m in enumerate(ms)], "gene string, sample_idx int, grp string")
    net = spark.createDataFrame([(s, "upregulates-expression", t, [], []) for s in ("S1", "S2") for t in ("T1", "T2", "T3")], PRIORS)
    for g, ms in mutated.items():
        alone = values.withColumn("grp", F.when(F.array(*map(F.lit, ms))[F.col("sample_idx")], "test").otherwise("control"))
        changes = detectors.changes(rows, alone, "significant-change-of-mean", {"protein": 0.05})
        assert {r.row_id: (round(r.p, 9), r.sign) for r in changes.collect()} == {r.row_id: (round(r.p, 9), r.sign) for r in search.group_changes(rows, values, groups, 0.05).where(F.col("gene") == g).collect()}
        for causal in (True, False):
            want = {tuple(r) for r in search.relations(search.satisfying(search.pairs(net, rows, changes), causal)).collect()}
            assert {tuple(r)[1:] for r in search.mutation_comparison(net, rows, values, groups, 0.05, causal=causal).where(F.col("gene") == g).collect()} == want
    assert ("A", "S1", "upregulates-expression", "T1") in {tuple(r) for r in search.mutation_comparison(net, rows, values, groups, 0.05).collect()}


def test_names_of_genes_follow_chains_and_ambiguous_ones_have_none(spark, tmp_path):
    lines = ["Approved\tPrevious\tAlias", "D\tC\talpha, beta", "C\tB\t", "B\tA\t", "X\tOLD|GONE\tbeta", "Y\tOLD\tgamma,X", "P\tQ\t", "Q\tP\t", "E\tgamma\t", "\tnone\t"]
    (tmp_path / "hgnc.txt").write_text("\n".join(lines) + "\n")
    got = {r.name: r.symbol for r in priors.current_symbols(tables.aliases(spark, str(tmp_path / "hgnc.txt"))).collect()}
    # gamma is previous of E before it is an alias of Y; OLD and beta stand for two; P and Q are on a circle
    assert got == {"A": "D", "B": "D", "C": "D", "D": "D", "alpha": "D", "X": "X", "GONE": "X", "Y": "Y", "E": "E", "gamma": "E"}
    long_chain = [(f"n{i}", f"n{i + 1}", 1) for i in range(100)] + [(f"n{i}", f"n{i}", 0) for i in range(101)]
    far = priors.current_symbols(spark.createDataFrame(long_chain, "name string, symbol string, rank int"))
    assert {r.symbol for r in far.collect()} == {"n100"} and far.count() == 101
    net = spark.createDataFrame([("A", "phosphorylates", "GONE", ["PMID:1"], [("S", 1)]), ("D", "phosphorylates", "X", ["PMID:2"], [("S", 2)]), ("beta", "phosphorylates", "X", [], []), ("CHEBI:1", "consumes", "alpha", [], []), ("X", "acetylates", "nobody", [], [])], PRIORS)
    kept = {(r.source, r.rel_type, r.target, tuple(sorted(r.mediators or []))) for r in priors.with_current_symbols(net, priors.current_symbols(tables.aliases(spark, str(tmp_path / "hgnc.txt")))).collect()}
    assert kept == {("D", "phosphorylates", "X", ("PMID:1", "PMID:2")), ("CHEBI:1", "consumes", "D", ())}


def test_directories_are_found_and_one_failure_does_not_stop_the_rest(spark, tmp_path):
    def study(path, good=True):
        path.mkdir(parents=True)
        (path / "data.txt").write_text("ID\tSymbols\tSites\tEffect\tv\nA-1\tA\tS1\ta\t2\nB-1\tB\tS1\ta\t2\n")
        (path / "priors.txt").write_text("A\tphosphorylates\tB\t\tS1\n")
        (path / "parameters.txt").write_text(f"proteomics-values-file = {'data' if good else 'nothing'}.txt\nid-column = ID\nvalue-column = v\nvalue-transformation = arithmetic-mean\nthreshold-for-data-significance = 1 phosphoprotein\ncustom-causal-priors-file = priors.txt\n")

    study(tmp_path / "one")
    study(tmp_path / "one" / "nested")  # below a hit: not run
    study(tmp_path / "deep" / "er" / "two")
    study(tmp_path / "broken", good=False)
    (tmp_path / "empty").mkdir()
    done = analysis.run_recursive(spark, str(tmp_path), threads=2)
    ends = {k.rpartition(str(tmp_path))[2]: v for k, v in done.items()}
    assert set(ends) == {"/one", "/deep/er/two", "/broken"} and ends["/one"] is None and ends["/deep/er/two"] is None and "nothing.txt" in ends["/broken"]
    assert (tmp_path / "one" / "output" / "causative.sif").exists() and not (tmp_path / "one" / "nested" / "output").exists()


def test_missing_values_by_random_tables_in_a_run(spark, tmp_path):
    names = [f"c{i}" for i in range(5)] + [f"t{i}" for i in range(5)]
    rng = np.random.default_rng(2)
    lines = ["\t".join(["ID", "Symbols", "Sites", "Effect", *names])]
    for k in range(12):
        cells = [f"{x:.3f}" for x in rng.normal(5, 1, 10)]
        gone = range(5, 10) if k == 0 else rng.choice(10, 3, replace=False)
        for i in gone:
            cells[i] = ""
        lines.append("\t".join([f"G{k}", f"G{k}", "", "", *cells]))
    (tmp_path / "data.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "priors.txt").write_text("".join(f"G{k}\tupregulates-expression\tG{k + 1}\n" for k in range(11)))
    keys = ["proteomics-values-file = data.txt", "id-column = ID", "value-transformation = significant-change-of-mean", "threshold-for-data-significance = 0.05 protein", "custom-causal-priors-file = priors.txt", "use-missing-proteomic-data-for-test = true", "randomized-matrix-directory-for-missing-proteomic-data = any"]
    (tmp_path / "parameters.txt").write_text("\n".join([*keys, *(f"{'control' if n[0] == 'c' else 'test'}-value-column = {n}" for n in names)]) + "\n")
    done = analysis.run_directory(spark, str(tmp_path))
    g0 = done.changes.where("row_id = 'G0'").first()
    assert g0.p < 0.1 and g0.value < 0


def test_what_is_drawn(spark):
    rows = [("a", "A", 1), ("a0", "A", 0), ("b", "B", -1), ("b2", "B", 1), ("c", "C", 1), ("c0", "C", 0), ("far", "F", 1)]
    data = spark.createDataFrame([(g, r, "protein" if len(r) == 1 else "phosphoprotein", 1, float(s), s) for r, g, s in rows], "gene string, row_id string, data_type string, effect int, value double, sign int")
    net = spark.createDataFrame([("A", "phosphorylates", "B", ["PMID:1"], [("S", 5), ("S", 3)]), ("A", "phosphorylates", "C", [], [])], PRIORS)
    found = spark.createDataFrame([("A", "phosphorylates", "B", "a", "b2")], "source string, rel_type string, target string, src_row string, tgt_row string")
    ids = lambda x: ({r.gene for r in x[0].collect()}, {r.row_id for r in x[1].collect()})
    assert ids(sinks.drawn(found, net, data)) == ({"A", "B"}, {"a", "b", "b2"})
    assert ids(sinks.drawn(found, net, data, evidence_only=True)) == ({"A", "B"}, {"a", "b2"})
    assert ids(sinks.drawn(found, net, data, every_gene=True)) == ({"A", "B", "C"}, {"a", "b", "b2", "c"})
    genes, shown = sinks.drawn(found, net, data, every_gene=True, unchanged=True)
    assert ids((genes, shown)) == ({"A", "B", "C"}, {"a", "b", "b2", "c", "c0"})
    assert [r.source for r in sinks.isolated(genes, search.relations(found)).collect()] == ["C"]
    significant = spark.createDataFrame([("A", True, True, True), ("B", False, False, True), ("F", True, True, False)], "gene string, crowded boolean, activating boolean, inhibiting boolean")
    lines = sinks.formats(genes, shown, 1.0, significant)
    got = {(r.id, r.property, r.setting) for r in lines.collect()}
    assert {x for x in got if x[1].startswith("border") or x[0] == "all-nodes"} == {("all-nodes", "color", "255 255 255"), ("all-nodes", "bordercolor", "50 50 50"), ("A", "borderwidth", "2"), ("A", "bordercolor", "150 150 0"), ("B", "bordercolor", "180 0 20")}
    assert ("A", "color", "255 80 40") in got and ("B", "rppasite", "b2|p|255 80 40|0 180 20|1.0") in got and ("B", "color", "40 80 255") in got
    assert not any(p == "color" for i, p, _ in ((r.id, r.property, 0) for r in sinks.formats(genes, shown, background=False).collect()) if i != "all-nodes")
    texts = [json.loads(r.json)  for r in sinks.graph_json(search.relations(found).join(net, ["source", "rel_type", "target"]), lines).collect()]
    assert {"data": {"source": "A", "target": "B", "edgeType": "phosphorylates", "tooltipText": "B_3, B_5", "pcLinks": ["PMID:1"]}} in texts
    assert {"data": {"id": "A", "text": "A", "sites": [], "tooltipText": "a, 1.0"}, "css": {"backgroundColor": "rgb(255,80,40)", "borderColor": "rgb(150,150,0)", "borderWidth": "2px"}} in texts


@pytest.mark.parametrize("more,genes,marks", [("", {"A", "B"}, {"B-1"}), ("show-all-genes-with-proteomic-data = true\n", {"A", "B", "C"}, {"B-1", "C-1"}), ("hide-data-not-part-of-causal-relations = true\n", {"A", "B"}, {"B-1"})])
def test_parameters_of_drawing(spark, tmp_path, more, genes, marks):
    (tmp_path / "data.txt").write_text("ID\tSymbols\tSites\tEffect\tv\nA\tA\t\t\t2\nB-1\tB\tS1\ta\t2\nC-1\tC\tS1\ti\t-2\nC-2\tC\tS2\ti\t0\n")
    (tmp_path / "priors.txt").write_text("A\tphosphorylates\tB\tPMID:7\tS1\nC\tphosphorylates\tA\t\tS9\n")
    (tmp_path / "parameters.txt").write_text("proteomics-values-file = data.txt\nid-column = ID\nvalue-column = v\nvalue-transformation = arithmetic-mean\nthreshold-for-data-significance = 1 phosphoprotein\nthreshold-for-data-significance = 1 protein\ncustom-causal-priors-file = priors.txt\n" + more)
    analysis.run_directory(spark, str(tmp_path))
    out = tmp_path / "output"
    assert {r.source for r in tables.sif(spark, str(out / "causative.sif")).collect()} - {"source"} | {"B"} == genes
    lines = tables.format_lines(spark, str(out / "causative.format")).where("property = 'rppasite'").collect()
    assert {r.setting.split("|")[0] for r in lines} == marks
    texts = [json.loads(r.value) for r in spark.read.text(str(out / "causative.json")).collect()]
    assert [t["data"]["pcLinks"] for t in texts if "source" in t["data"]] == [["PMID:7"]]


STAR = ["graph_json", "isolated_changed_genes", "network_significance_counts", "sequences_by_change", "kinase_scores", "kinase_activity", "mutation_effect_t", "current_symbols"]


@pytest.mark.parametrize("name", STAR)
def test_star_queries_match_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("nation", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.SQL[name])
    columns = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    key = lambda r: tuple(repr(x) for x in r)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key) == sorted((tuple(r[names.index(c)] for c in columns) for r in want.fetchall()), key=key)


@pytest.mark.parametrize("name", ["mutation_comparison", "robustness", "missing_value_p", "correlation_network_significance"])
def test_star_queries_without_sql_run(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_a_deviation_of_the_limit_itself_reaches_it_in_any_order(spark):
    """Whole numbers of variance 225 exactly; summed in some orders their deviation comes out under 15."""
    orders = [p for v in ((0, 0, 20, 30), (0, 10, 30, 30), (0, 22, 24, 36)) for p in set(itertools.permutations(v))] + [(0, 9, 18, 34)]
    rows = spark.createDataFrame([(f"r{i}", "protein", [f"R{i}"], None, 1) for i in range(len(orders))], ROWS)
    values = spark.createDataFrame([(f"r{i}", 0, j, "all", float(x)) for i, v in enumerate(orders) for j, x in enumerate(v)], VALUES)
    kept = {r.row_id for r in detectors.stdev_filter(rows, values.coalesce(1), {"protein": 15.0}).collect()}
    assert kept == {f"r{i}" for i in range(len(orders) - 1)}


def test_rows_of_a_drawing_are_looked_at_once(spark):
    """Total rows give a colour and a tooltip, other rows a site mark, from one window over them."""
    data = spark.createDataFrame([("G", "G", "protein", 1, 2.0, 1), ("G", "G-1", "phosphoprotein", -1, -2.0, -1), ("H", "H-1", "phosphoprotein", 0, 1.0, 1), ("K", "K", "protein", 1, 1.0, 1)], "gene string, row_id string, data_type string, effect int, value double, sign int")
    lines = sinks.formats(spark.createDataFrame([("G",), ("H",)], "gene string"), data, 2.0)
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("Window") == 1
    assert sorted((r.id, r.property) for r in lines.collect()) == [("G", "color"), ("G", "rppasite"), ("G", "tooltip"), ("H", "rppasite"), ("all-nodes", "bordercolor"), ("all-nodes", "color")]


def test_tables_of_pairs_are_counted_from_bits(spark):
    """As counted from rows of pair and sample, with gaps, samples before 0 and beyond a word, and pairs that never meet; no aggregate by pair and category."""
    rng = np.random.default_rng(8)
    cells = [(r, 0, int(i), "all", float(rng.integers(0, 2 + (r < "d")))) for r in "abcdef" for i in range(-70, 150, 7) if rng.random() < 0.7]
    values = spark.createDataFrame([*cells, ("g", 0, 1000, "all", 1.0), ("c", 1, 3, "all", 9.0), ("d", 0, 4, "all", None)], VALUES)
    pairs = spark.createDataFrame([(a, b) for a in "abc" for b in "cdefg"], "a string, b string")
    want = {(r.a, r.b): r for r in pairwise.categorical_categorical(pairwise.paired_values(pairs, values)).collect()}
    found = pairwise.categorical_pairs(pairs, values)
    assert {(r.a, r.b): r for r in found.collect()} == want and len(want) == 12
    assert not any("Aggregate" in line and "keys=[a#" in line and "x#" in line for line in found._jdf.queryExecution().toString().splitlines())


def test_statistics_of_pairs_are_summed_where_the_pair_lies(spark):
    """Against numpy, with ties, gaps and samples from any number on; no plan shuffles or sorts by sample or by pair and value."""
    rng = np.random.default_rng(5)
    cells = {(r, i): float(rng.integers(0, 4)) for r in "abcdef" for i in range(-2, 14) if rng.random() < 0.8}
    values = spark.createDataFrame([(r, 0, i, "all", x) for (r, i), x in cells.items()], VALUES)
    pairs = spark.createDataFrame([(a, b) for a in "abc" for b in "def"], "a string, b string")
    both = {(a, b): [(cells[a, i], cells[b, i]) for i in range(-2, 14) if (a, i) in cells and (b, i) in cells] for a in "abc" for b in "def"}
    rank = lambda v: [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]
    found = pairwise.paired_values(pairs, values)
    pearson, spearman = pairwise.pearson(found), pairwise.spearman_pairs(pairs, values)
    for df in (pearson, spearman):
        plan = df._jdf.queryExecution().toString()
        assert "hashpartitioning(b#" in plan and not any("hashpartitioning" in line and "sample_idx" in line for line in plan.splitlines()) and "Window" not in plan
    number, table = pairwise.categorical_numeric(found), pairwise.categorical_categorical(found)
    got = [{(r.a, r.b): r for r in df.collect()} for df in (pearson, spearman, number, table)]
    for pair, met in both.items():
        x, y = zip(*met, strict=True)
        r = np.corrcoef(x, y)[0, 1]
        assert [g[pair].n for g in got] == [len(met)] * 4
        assert [got[0][pair].r, got[2][pair].r, got[3][pair].r] == pytest.approx([r] * 3) and got[1][pair].r == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
        groups = [[b for a, b in met if a == k] for k in sorted(set(x))]
        within = sum(sum((v - np.mean(g)) ** 2 for v in g) for g in groups)
        f = sum(len(g) * (np.mean(g) - np.mean(y)) ** 2 for g in groups) / (len(groups) - 1) / (within / (len(met) - len(groups)))
        assert got[2][pair].p == pytest.approx(stats.f_upper(np.array([f]), np.array([len(groups) - 1.0]), np.array([float(len(met) - len(groups))]))[0])
        chi = sum((met.count((a, b)) - x.count(a) * y.count(b) / len(met)) ** 2 / (x.count(a) * y.count(b) / len(met)) for a in set(x) for b in set(y))
        assert got[3][pair].p == pytest.approx(stats.chi2_upper(np.array([chi]), np.array([(len(set(x)) - 1.0) * (len(set(y)) - 1)]))[0])


def test_rows_are_tested_once_for_all_genes(spark):
    """70 genes, more than one word of bits: as Welch's test of values joined to groups, without such a join; equal values have no variance."""
    rng = np.random.default_rng(9)
    names = ["s1", "s2", "t1", "t2", "t3"]
    rows = spark.createDataFrame([(r, "protein", [r.upper()], None, 1) for r in names], ROWS)
    data = [(r, 0, i, "all", 0.1 if r == "t3" else float(rng.integers(0, 9))) for r in names for i in range(3, 15) if r == "t3" or rng.random() < 0.8]
    values = spark.createDataFrame(data, VALUES)
    groups = spark.createDataFrame([(f"G{g}", i, ["test", "control", "other"][rng.choice(3, p=[0.45, 0.45, 0.1])]) for g in range(70) for i in range(12) if g], "gene string, sample_idx int, grp string")
    got = search.group_changes(rows, values, groups, 0.95)
    assert "sample_idx" not in "".join(line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line or "hashpartitioning" in line)
    want = detectors.welch(values.select("row_id", "sample_idx", "value").join(groups, "sample_idx"), 0, ("gene", "row_id"))
    number = lambda x: None if x is None else round(x, 9)
    both = [{(r.gene, r.row_id): (number(r.diff), number(r.t), number(r.df)) for r in df.collect()} for df in (got, want)]
    assert both[0] == both[1] and any(k[1] == "t3" and v[1] is None for k, v in both[0].items())
    net = spark.createDataFrame([(s, "upregulates-expression", t, [], []) for s in ("S1", "S2") for t in ("T1", "T2", "T3")], PRIORS)
    sign = {(r.gene, r.row_id): r.sign for r in got.collect()}
    for causal in (True, False):
        held = {(f"G{g}", s, "upregulates-expression", t) for g in range(1, 70) for s in ("S1", "S2") for t in ("T1", "T2", "T3") if sign.get((f"G{g}", s.lower()), 0) * sign.get((f"G{g}", t.lower()), 0) == (1 if causal else -1)}
        found = [tuple(r) for r in search.mutation_comparison(net, rows, values, groups, 0.95, causal=causal).collect()]
        assert len(found) == len(held) and set(found) == held and {f[0] for f in found} & set(sorted(f"G{g}" for g in range(1, 70))[64:])
