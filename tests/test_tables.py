"""Hand-sized tables: statistics, scores, validation, text columns, sources."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from preyscope.functions import stats, text
from preyscope.operators import analytics, groups, impute, ingest, network, ontology, score_counts, score_intensity, scoring, validate, wd
from preyscope.plans import pipeline
from preyscope.sources import readers, writers


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


def test_tail_fdr(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.9), (3, 0.5), (4, 0.0)], "i int, p double")
    out = {r.i: r.bfdr for r in stats.tail_fdr(df, "p").collect()}
    assert out[1] == out[2] == 0 and out[3] == pytest.approx(0.1) and out[4] == pytest.approx(1 - 2.3 / 3)
    assert stats.tail_fdr(df.limit(0), "p").count() == 0


def test_bh(spark):
    p = [0.01, 0.02, 0.02, 0.5, 1.0, None]
    out = {r.i: r.q for r in stats.bh_adjust(spark.createDataFrame([*enumerate(p)], "i int, p double"), "p", "q").collect()}
    assert [out[i] for i in range(5)] == pytest.approx([0.02 * 5 / 3] * 3 + [0.625, 1.0]) and out[5] is None


def test_densities(spark):
    df = spark.range(0, 200).select(F.col("id").alias("k"))
    got = {r.k: r.v for r in df.select("k", stats.log_factorial(F.col("k")).alias("v")).collect()}
    assert all(got[k] == pytest.approx(math.lgamma(k + 1), abs=1e-10) for k in range(200))
    cases = [(t, n) for t in (0.0, 0.3, 1.7, 4.0) for n in (1, 2, 3, 4, 7, 10)]
    out = spark.createDataFrame(cases, "t double, n int").select("t", "n", stats.t_two_sided(F.col("t"), F.col("n")).alias("p")).collect()
    for r in out:
        x = np.linspace(-r.t, r.t, 20001)
        density = np.exp(math.lgamma((r.n + 1) / 2) - math.lgamma(r.n / 2)) / math.sqrt(r.n * math.pi) * (1 + x * x / r.n) ** (-(r.n + 1) / 2)
        assert r.p == pytest.approx(1 - np.trapezoid(density, x), abs=1e-6)
    (r,) = spark.createDataFrame([(3, 6, 8, 30)], "k long, n long, m long, t long").select(stats.hypergeom_tail(*map(F.col, "knmt")).alias("p")).collect()
    assert r.p == pytest.approx(sum(math.comb(8, i) * math.comb(22, 6 - i) for i in range(3, 7)) / math.comb(30, 6))


def dense_wd(cells, k):
    """Plain version over the dense matrix: (experiment, prey) -> wd before normalisation."""
    names, preys = sorted({e for e, _ in cells}), sorted({p for _, p in cells})
    out = {}
    for p in preys:
        x = np.array([cells.get((e, p), (0, 0, ""))[0] for e in names], float)
        saw = np.array([cells.get((e, p), (0, 0, ""))[1] for e in names])
        own = np.array([cells.get((e, p), (0, 0, ""))[2] == p for e in names])
        alone = own.sum() == (x > 0).sum()
        n = 1 if alone else (saw > 0).sum()
        mean = x / k if alone else np.full(k, (x.sum() - x[own].sum()) / k)
        sse = (x - mean) ** 2 + mean**2 * k if alone else np.full(k, (np.where(own, mean, x) - mean) ** 2 @ np.ones(k))
        sd = np.sqrt(sse / (k - 1))
        for i, e in enumerate(names):
            if (e, p) in cells:
                out[e, p] = math.sqrt(x[i] * (sd[i] / mean[i] * k / n) ** saw[i]) if mean[i] and sd[i] else None
    return out


def test_wd_against_dense(spark):
    rng = random.Random(1)
    data = [(f"B{b}", r, f"P{b}", f"P{p}", float(rng.randrange(0, 9))) for b in range(5) for r in (1, 2) for p in range(12) if rng.random() < 0.6]
    data += [("B1", 1, "P1", "own", 3.0), ("B3", 1, "P99", "P99", 4.0), ("B3", 1, "P99", "P99", 2.0)]
    data = [(e, r, "P99" if e == "B3" else b, p, c) for e, r, b, p, c in data]
    counts = spark.createDataFrame(data, "experiment string, replicate int, bait string, prey string, count double")
    best = {}
    for e, r, b, p, c in data:
        best[e, p, r] = max(c, best.get((e, p, r), (0.0,))[0] if (e, p, r) in best else 0.0), b
    cells = {}
    for (e, p, _), (c, b) in best.items():
        x, n, s, _ = cells.get((e, p), (0.0, 0, 0, b))
        cells[e, p] = x + c, n + 1, s + (c > 0), b
    plain = {k: (x / n, s, b) for k, (x, n, s, b) in cells.items()}
    expected = dense_wd(plain, 5)
    out = {(r.experiment, r.prey): r for r in wd.wd_scores(counts, quantile=None).collect()}
    assert out.keys() == expected.keys()
    for key, value in expected.items():
        assert out[key].wd == (pytest.approx(value) if value is not None else None)
    exact = {(r.experiment, r.prey): r.p_value for r in out.values()}
    near = wd.wd_scores(counts, quantile=None, iterations=2000).collect()
    assert all(abs(r.p_value - exact[r.experiment, r.prey]) < 0.06 for r in near if r.p_value is not None)


DESIGN = [(f"E{b}{r}", f"B{b}", f"P{b}", "C" if b > 2 else "T", r, None) for b in range(5) for r in (1, 2, 3)]
DESIGN_SCHEMA = "experiment string, bait string, bait_id string, type string, replicate int, grp string"


def planted(spark, scale=1.0):
    rng = random.Random(3)
    data = [(e, f"P{p}", scale * (30.0 + rng.random() if b == "B0" and p < 5 else rng.choice([1.0, 2.0, 3.0]) + rng.random() / 9)) for e, b, *_ in DESIGN for p in range(20) if p < 5 or rng.random() < 0.8]
    preys = spark.createDataFrame([(f"P{p}", f"B{p}" if p == 7 else f"G{p}") for p in range(20)], "prey string, gene string")
    return spark.createDataFrame(data, "experiment string, prey string, value double"), spark.createDataFrame(DESIGN, DESIGN_SCHEMA), preys


@pytest.mark.parametrize("model", [score_counts, score_intensity])
def test_planted_signal(spark, model):
    inter, design, preys = planted(spark, 1.0 if model is score_counts else 1000.0)
    out = {(r.prey, r.bait): r for r in model.score(inter, design, preys).collect()}
    hits = [out[f"P{p}", "B0"] for p in range(5)]
    others = [r for k, r in out.items() if k[1] != "B0"]
    assert min(r.avg_p for r in hits) > 0.9 and np.mean([r.avg_p for r in others]) < 0.3 and max(r.bfdr for r in hits) <= min(r.bfdr for r in others)
    assert all(a.bfdr <= b.bfdr for a in out.values() for b in out.values() if a.avg_p > b.avg_p)
    again = {(r.prey, r.bait): r.avg_p for r in model.score(inter.repartition(5), design, preys).collect()}
    assert again == {k: r.avg_p for k, r in out.items()}


def test_one_universal_control_equals_an_ungrouped_run(spark):
    inter, design, preys = planted(spark)
    grouped = design.withColumn("grp", F.when(F.col("type") == "C", "*").otherwise("1"))
    members = groups.memberships(grouped)
    one = score_counts.score(groups.scope_to_groups(inter, members), members, preys, by=["source_group"])
    assert rows(one, "prey", "bait", "avg_p", "bfdr") == rows(score_counts.score(inter, design, preys), "prey", "bait", "avg_p", "bfdr")


def test_group_cells_and_rules(spark):
    cells = [None, "", "*", "1", "1,2", " 1 , 2 ", "*,1", "0", "a", ","]
    got = {c: r for c, r in zip(cells, spark.createDataFrame([(c,) for c in cells], "c string").select(text.group_spec(F.col("c")).alias("g")).collect(), strict=True)}
    assert [list(got[c].g.groups) for c in cells] == [[], [], [], [1], [1, 2], [1, 2], [], [], [], []]
    assert [got[c].g.is_valid for c in cells] == [True, True, True, True, True, True, False, False, False, False] and got["*"].g.is_universal
    design = spark.createDataFrame([("a", "T", "1"), ("b", "T", "*"), ("c", "T", "1,2"), ("d", "T", None), ("e", "C", "2"), ("f", "C", "3")], "experiment string, type string, grp string")
    assert rows(validate.group_rules(design), "rule", "key") == sorted([("star_on_test", "b"), ("several_groups", "c"), ("test_without_group", "d"), ("group_without_control", "1"), ("warning_control_without_test", "3")], key=repr)
    names = spark.createDataFrame([("ok_1",), ("",), ("a b",), ("used",)], "name string")
    assert rows(validate.validate_name(names, spark.createDataFrame([("used",)], "name string")), "rule") == [("empty_name",), ("invalid_name",), ("name_in_use",)]


def test_text_columns(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v")).alias("x")).first().x
    assert one(text.short_ids, "a;b;c") == "a;b;c" and one(text.short_ids, "a a;b;c;d;e") == "a-a;b;c;+2"
    assert one(text.first_location, "SUBCELLULAR LOCATION: [Isoform 1]: Nucleus {ECO:1}; x") == "[Isoform 1" and one(text.first_location, "SUBCELLULAR LOCATION: Cell membrane, inner. y") == "Cell membrane"
    assert one(text.first_location, None) is None
    assert one(text.clean_go, "a b [GO:0000001]; c [GO:0000002]") == "a b; c" and one(text.go_ids, "a [GO:0000001]; c [GO:0000002]") == ["GO:0000001", "GO:0000002"]
    assert one(text.feature_notes, 'MOTIF 1..2; /note="x y"; /note="z"') == "x y; z" and one(text.feature_notes, "none") is None
    assert one(text.intensities, "1.5|.| |x|2") == [1.5, 2.0] and one(text.features, "Zinc 1; 2nd; Zinc 2;;WW") == ["Zinc", "WW"]


def test_ontology_diamond(spark):
    obo = [("r", None), ("a", ("r", "isa")), ("b", ("r", "partof")), ("t", ("a", "isa")), ("t", ("b", "isa")), ("t", ("elsewhere", "isa"))]
    terms = spark.createDataFrame([("n", t, p[0] if p else None, p[1] if p else None) for t, p in obo], "namespace string, term string, parent string, kind string")
    out = {(r.term, r.ancestor): r.value for r in ontology.semantic_values(ontology.weigh(ontology.edges(terms))).collect()}
    up, a, b = 1 / 1.67 + 0.4, 1 / 2.67 + 0.4, 1 / 2.67 + 0.3
    assert out["t", "r"] == pytest.approx(max(up * a, up * b)) and out["t", "a"] == pytest.approx(up) and out["t", "t"] == 1 and len(out) == 9


def test_msstats_shape(spark):
    """Five proteins in six runs, one missing value a run; a heavy row, a duplicate and an unknown run."""
    rng = random.Random(0)
    data = [(f"Q{p}", "L", None if p == r % 5 else rng.gauss(8, 1.5), f"R{r}") for p in range(5) for r in range(6)]
    data += [("Q0", "H", 1.0, "R1"), ("Q1", "L", 3.0, "R9"), ("Q9", "L", 2.0, "R0"), ("Q9", "L", 4.0, "R0")]
    raw = spark.createDataFrame(data, "prey string, label string, log_intensity double, experiment string")
    clean = ingest.msstats_clean(raw)
    assert clean.count() == 26 and {r.prey: r.value for r in clean.collect()}["Q9"] == pytest.approx(8.0)
    wide = ingest.pivot_runs(clean, [f"R{r}" for r in range(6)])
    assert wide.count() == 6 and wide.columns == ["prey", *[f"R{r}" for r in range(6)]]


def test_fits_reach_the_grid_optimum(spark):
    inter, design, preys = planted(spark, 1000.0)
    bounds = impute.limits(inter)
    data = impute.censor_stats(inter, F.lit(15), bounds).toPandas()
    for pi in (0.0, 0.3):
        got = impute.fit(impute.censor_stats(inter, F.lit(15), bounds), "mixture", pi).toPandas().set_index("prey")
        value = impute.mixture_value(data, pi)
        best = value(got.loc[data.prey, ["mu"]].to_numpy(), got.loc[data.prey, ["sigma"]].to_numpy())[:, 0]
        for i in range(len(data)):
            mu, sigma = np.meshgrid(np.linspace(data.mu_low[i], data.mu_high[i], 200), np.linspace(data.sigma_floor[i], data.sigma_high[i], 200))
            grid = impute.mixture_value(data.iloc[[i]], pi)(mu.reshape(1, -1), sigma.reshape(1, -1)).max()
            assert best[i] >= grid - 1e-3
    out = impute.impute(inter, design, preys, "mixture", 0.1)
    assert out.count() == 20 and out.where("imputed and imputed_mu <= 0").count() == 0


def test_beta_is_the_likeliest():
    for p in (0.01, 0.3, 0.9):
        grid = np.linspace(-15, 15, 30001)
        assert scoring.beta_of(p) == pytest.approx(grid[(p * grid - np.log1p(np.exp(grid))).argmax()], abs=2e-3)
    assert scoring.beta_of(0.0) == -15 and scoring.beta_of(1.0) == 15 and scoring.beta_of(None) == 0


def test_beta_gamma(spark):
    rng = np.random.default_rng(1)
    s = rng.integers(0, 4, 4000)
    z = rng.random(4000) < 1 / (1 + np.exp(2 - 0.8 * s))
    b, g = network.fit_beta_gamma(spark.createDataFrame([(float(x), float(y)) for x, y in zip(s, z, strict=True)], "support double, z double"))
    assert b == pytest.approx(-2, abs=0.25) and g == pytest.approx(0.8, abs=0.15)


def test_sources(spark, tmp_path):
    (tmp_path / "d.csv").write_bytes("﻿Experiment Name,Type,Bait,Replicate,Group\nE1,T,B1,1,\nE2,C,Bé,1,*\n".encode())
    (tmp_path / "latin.csv").write_bytes("Experiment Name,Type,Bait,Replicate\nE1,T,Bé,1\n".encode("latin-1"))
    assert rows(readers.read_design(spark, str(tmp_path / "d.csv")), "experiment", "bait", "grp") == [("E1", "B1", None), ("E2", "Bé", "*")]
    assert readers.read_design(spark, str(tmp_path / "latin.csv")).first().bait == "Bé"
    (tmp_path / "diann.tsv").write_text("Protein.Group\tProtein.Names\tGenes\tE1\tE2\tE9\nP1;P2\tx\tG1\t5\t\t7\n")
    wide = readers.read_diann(spark, str(tmp_path / "diann.tsv"), ["E1", "E2"])
    assert (wide.first().E1, wide.first().E2, "E9" in wide.columns, wide.first().length) == (5.0, 0.0, False, "1")
    (tmp_path / "frag.tsv").write_text("Protein\tProtein ID\tGene\tProtein Length\tE1 Intensity\tE1 MaxLFQ Intensity\tE1 Total Spectral Count\ncontam_x\tP1\tG\t10\t3\t4\t5\n")
    frag = readers.read_fragpipe(spark, str(tmp_path / "frag.tsv"), ["E1"])
    assert (frag.first().E1, frag.first().contaminant) == (3.0, "+") and ingest.drop_flagged(frag).count() == 0
    assert validate.header_experiments(["E1 Intensity", "E1 MaxLFQ Intensity", "x"], "fragpipe") == ["E1"]
    (tmp_path / "o.obo").write_text("format: 1\n\n[Term]\nid: GO:1\nnamespace: p\nis_a: GO:2 ! x\nrelationship: part_of GO:3 ! y\n\n[Term]\nid: GO:4\nnamespace: p\nis_obsolete: true\n\n[Term]\nid: GO:2\nnamespace: p\n")
    assert rows(readers.read_obo(spark, str(tmp_path / "o.obo"))) == sorted([("GO:1", "p", "GO:2", "isa"), ("GO:1", "p", "GO:3", "partof"), ("GO:2", "p", None, None)], key=repr)
    with pytest.raises(ValueError, match="missing columns: Gene"):
        readers.check_columns(wide, ["prey", "Gene"])
    scored = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "source_group int, prey string")
    writers.write_groups(scored, spark.createDataFrame([(1, "T"), (1, "C"), (2, "T")], "source_group int, type string"), str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out/groups")), "prey", "source_group") == rows(scored, "prey", "source_group")


def test_full_run_on_a_wide_file(spark, tmp_path):
    inter, design, preys = planted(spark, 1000.0)
    cells = {(r.prey, r.experiment): r.value for r in inter.collect()}
    names = [d[0] for d in DESIGN]
    (tmp_path / "diann.tsv").write_text("\t".join(["Protein.Group", "Genes", *names]) + "\n" + "".join("\t".join([f"P{p}", f"G{p}", *[str(cells.get((f"P{p}", e), "")) for e in names]]) + "\n" for p in range(20)))
    (tmp_path / "design.csv").write_text("Experiment Name,Type,Bait,Replicate,Bait ID\n" + "".join(f"{e},{t},{b},{r},{i}\n" for e, b, i, t, r, _ in DESIGN))
    out = pipeline.run(spark, "diann", str(tmp_path / "diann.tsv"), str(tmp_path / "design.csv"), imputation="one")
    best = out.orderBy(F.desc("avg_p"), "bfdr").limit(5).collect()
    assert {r.bait for r in best} == {"B0"} and out.where("wd is not null").count() == out.count()
    (tmp_path / "design.csv").write_text("Experiment Name,Type,Bait,Replicate\nE01,X,B0,0\n")
    with pytest.raises(ValueError, match="valid_type"):
        pipeline.run(spark, "diann", str(tmp_path / "diann.tsv"), str(tmp_path / "design.csv"))


def test_pca_matches_a_direct_decomposition(spark):
    inter, design, _ = planted(spark)
    matrix = analytics.pca_matrix(inter, design)
    scores, explained = analytics.pca(inter, design)
    wide = matrix.toPandas().pivot(index="experiment", columns="prey", values="z").sort_index()
    x = wide.to_numpy() - wide.to_numpy().mean(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert explained == pytest.approx((s**2 / (s**2).sum())[:2].tolist())
    got = np.array([[r.pc1, r.pc2] for r in scores.orderBy("experiment").collect()])
    assert np.abs(got) == pytest.approx(np.abs(u[:, :2] * s[:2]), abs=1e-6)
