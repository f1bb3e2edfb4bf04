"""Fits, topology scores, exemplars, ranges and annotation files against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from preyscope.functions import stats
from preyscope.operators import affinity, annotate, impute, network, score_counts, scoring, validate, wd
from preyscope.plans import pipeline
from preyscope.sources import readers

from .test_tables import DESIGN, planted


def normal_cdf(x):
    return 0.5 * math.erfc(-x / math.sqrt(2))


def density(x, mu, sigma):
    return math.exp(-((x - mu) ** 2) / (2 * sigma**2)) / (sigma * math.sqrt(2 * math.pi))


def plain_prior(ys, n_zero, tlim, mu, sigma):
    om, osd = np.mean(ys), np.std(ys) or 0.5
    return sum(math.log10(density(y, mu, sigma) + 1e-6) for y in ys) + n_zero * math.log10(normal_cdf((tlim - mu) / sigma) + 1e-6) + math.log10(density(mu, om, osd / math.sqrt(len(ys))) + 1e-6)


def plain_one(ys, n_zero, tlim, mu, sigma):
    return sum(math.log(density(y, mu, sigma)) for y in ys) + n_zero * math.log(max(normal_cdf((tlim - mu) / sigma), 1e-12))


@pytest.mark.parametrize("mode, plain", [("prior", plain_prior), ("one", plain_one)])
def test_fits_against_plain_likelihoods(spark, mode, plain):
    inter, _, _ = planted(spark, 1000.0)
    found = impute.censor_stats(inter, F.lit(15), impute.limits(inter, mode), mode, values=True)
    fits = impute.fit(found, mode).toPandas().sort_values("prey").head(8)
    for r in fits.itertuples():
        best = plain(list(r.ys), r.n_zero, r.tlim, r.mu, r.sigma)
        for mu in np.linspace(r.mu_low, r.mu_high, 60):
            for sigma in np.linspace(r.sigma_floor, r.sigma_high, 60):
                assert plain(list(r.ys), r.n_zero, r.tlim, mu, sigma) <= best + 2e-3


def test_a_vanishing_tail_stops_at_the_floor():
    import pandas as pd

    p = pd.DataFrame([{"n_obs": 2.0, "n_zero": 5.0, "sum_y": 20.0, "sum_yy": 200.0, "tlim": -50.0}])
    at = np.array([[10.0]]), np.array([[1.0]])
    with_floor, without = (impute.mixture_value(p, 0.0, floor)(*at)[0, 0] for floor in (1e-12, 0.0))
    assert with_floor == pytest.approx(5 * math.log(1e-12)) and without < with_floor


def test_ranges_of_values(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(500)] + [0.25] * 7
    df = spark.createDataFrame([(v, k % 3) for k, v in enumerate(values)], "v double, g int").repartition(6)
    got = stats.quantiles(df, {"a": ("v", 0.98), "b": ("v", 0.0), "c": ("v", 1.0), "d": ("v", 0.5)}).first()
    assert [got.a, got.b, got.c, got.d] == pytest.approx(np.quantile(values, [0.98, 0, 1, 0.5]).tolist())
    assert stats.quantiles(df.limit(0), {"a": ("v", 0.5)}).first().a is None
    medians = {r.g: r.median for r in stats.upper_median(df, "v", ["g"]).collect()}
    assert medians == {g: sorted(values[g::3])[len(values[g::3]) // 2] for g in range(3)}
    rows = spark.createDataFrame([(float(k), k % 5) for k in range(200)], "v double, n long").repartition(5)
    for down in (False, True):
        out = {r.v: (r.s, r.m) for r in stats.running(rows, "v", {"s": ("sum", "n"), "m": ("min", "n")}, down).collect()}
        seen = []
        for k in sorted(range(200), reverse=down):
            seen.append(k % 5)
            assert out[float(k)] == (sum(seen), min(seen))


def fit_plain(z, s):
    """(beta, gamma >= 0) by many small steps up the slope."""
    p = z.mean()
    if p in (0, 1):
        return math.copysign(15, p - 0.5), 0.0
    b, g = math.log(p / (1 - p)), 0.0
    for _ in range(20_000):
        r = z - 1 / (1 + np.exp(-(b + g * s)))
        b, g = min(15, max(-15, b + 0.5 * r.mean())), min(10.0, max(0.0, g + 0.5 * (r * s).mean()))
    return b, g


def plain_topology(cells, edges, rounds):
    beta = gamma = 0.0
    z = {k: c["z0"] for k, c in cells.items()}
    pairs = sorted({(p, b) for p, b, _ in cells})
    for _ in range(rounds):
        mean = {pb: np.mean([z[k] for k in cells if k[:2] == pb]) for pb in pairs}
        support = {(p, b): sum(mean.get((o, b), 0.0) for a, o in edges if a == p) for p, b in pairs}
        odds = {k: beta + gamma * support[k[:2]] + c["lt"] - c["lf"] for k, c in cells.items()}
        z = {k: o >= 0 for k, o in odds.items()}
        live = [pb for pb in pairs if not next(c["skip"] for k, c in cells.items() if k[:2] == pb)]
        beta, gamma = fit_plain(np.array([np.mean([z[k] for k in cells if k[:2] == pb]) for pb in live]), np.array([support[pb] for pb in live]))
    score = {k: 1 / (1 + math.exp(-(beta + gamma * support[k[:2]] + c["lt"] - c["lf"]))) if c["y"] else 0.0 for k, c in cells.items()}
    return {pb: np.mean([score[k] for k in cells if k[:2] == pb]) for pb in pairs}


def test_topology_against_a_plain_version(spark):
    inter, design, preys = planted(spark)
    cells = score_counts.densities(inter, design, preys)
    edges = [(f"P{a}", f"P{b}") for a in range(5) for b in range(a + 1, 5)] + [("P6", "P9")]
    pairs = score_counts.score(inter, design, preys).select("prey", "bait", "avg_p")
    out = network.topology_scores(cells, spark.createDataFrame(edges, "a string, b string"), pairs, rounds=3).collect()
    plain = plain_topology({(r.prey, r.bait, r.experiment): r.asDict() for r in cells.collect()}, edges, 3)
    assert len(out) == len(plain) and all(r.topo_avg_p == pytest.approx(plain[r.prey, r.bait], abs=2e-2) and r.score == max(r.topo_avg_p, r.avg_p) for r in out)
    assert {r.boosted_by for r in out if (r.prey, r.bait) == ("P3", "B0")} == {"P4"}


def plain_affinity(s, damping=0.5, rounds=200):
    """Exemplars by message passing over a dense matrix."""
    n = len(s)
    r, a = np.zeros((n, n)), np.zeros((n, n))
    for _ in range(rounds):
        v = a + s
        best = v.argmax(1)
        first = v[range(n), best]
        v[range(n), best] = -np.inf
        new = s - first[:, None]
        new[range(n), best] = s[range(n), best] - v.max(1)
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        np.fill_diagonal(p, r.diagonal())
        new = p.sum(0)[None, :] - p
        own = new.diagonal().copy()
        new = np.minimum(new, 0)
        np.fill_diagonal(new, own)
        a = damping * a + (1 - damping) * new
    heads = np.flatnonzero((r + a).diagonal() > 0)
    own = heads[s[:, heads].argmax(1)]
    own[heads] = heads
    return own


def test_exemplars_against_a_plain_version(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (5, 2)) for c in ((0, 0), (4, 0), (0, 5))])
    s = -((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(s, -10.0)
    edges = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", float(s[a, b])) for a in range(15) for b in range(a)], "a string, b string, similarity double")
    out = {r.node: r.exemplar for r in affinity.affinity_clusters(edges, -10.0, rounds=60, stable=15).collect()}
    own = plain_affinity(s)
    groups = lambda m: sorted(map(sorted, {c: [k for k in m if m[k] == c] for c in m.values()}.values()))
    assert groups(out) == groups({f"n{k:02d}": int(c) for k, c in enumerate(own)}) and len({*out.values()}) == 3
    for c in {*out.values()}:
        members = [int(k[1:]) for k in out if out[k] == c]
        totals = {k: sum(s[j, k] for j in members if j != k) for k in members}
        assert totals[int(c[1:])] == pytest.approx(max(totals.values()))


def test_d_scores_of_logarithms(spark):
    counts = spark.createDataFrame([("B0", 1, "P0", "a", 3.0), ("B0", 2, "P0", "a", 4.0), ("B1", 1, "P1", "a", 1.0), ("B2", 1, "P2", "b", 1.0)], "experiment string, replicate int, bait string, prey string, count double")
    out = {(r.experiment, r.prey): r.d for r in wd.d_scores(counts, by_counts=False).collect()}
    assert out["B0", "a"] == pytest.approx(math.sqrt((3 / 2) ** 2 * math.log2(8))) and out["B2", "b"] == pytest.approx(math.sqrt(3))


def test_terms_that_name_many_preys(spark, monkeypatch):
    monkeypatch.setattr(network, "TERM_PREYS", 7)
    terms = spark.createDataFrame([("x", " ".join(f"p{k}" for k in range(40))), ("y", "p1 p50 p50 q")], "term string, members string")
    preys = spark.createDataFrame([(f"p{k}",) for k in range(60)], "prey string")
    out = {tuple(r) for r in network.edges_from_terms(terms, preys).collect()}
    names = sorted(f"p{k}" for k in range(40))
    assert out == {(a, b) for a in names for b in names if a < b} | {("p1", "p50")}


def test_named_encodings(spark, tmp_path):
    (tmp_path / "d.csv").write_bytes("Experiment Name,Type,Bait,Replicate\nE1,T,“B€”,1\n".encode("cp1252"))
    assert readers.read_design(spark, str(tmp_path / "d.csv"), "windows-1252").first().bait == "“B€”"


def test_validation_of_each_format(spark):
    design = spark.createDataFrame([("E1", "T", "B1", "P1", "1", None), ("E2", "C", "B2", "P2", "1", None)], "experiment string, type string, bait string, bait_id string, replicate string, grp string")
    for kind, quants in {"maxquant": "Intensity {}", "diann": "{}", "fragpipe": "{} Intensity"}.items():
        columns = [*readers.REQUIRED[kind], *[quants.format(e) for e in ("E1", "E3")]]
        data = spark.createDataFrame([tuple("1" for _ in columns)], ", ".join(f"`{c}` string" for c in columns))
        found = {(r.rule, r.key) for r in validate.validate_inputs(design, data, kind).collect()}
        assert found == {("experiment_not_in_data", "E2"), ("warning_experiment_not_in_design", "E3")}, kind
        found = {(r.rule, r.key) for r in validate.validate_inputs(design, data.drop(columns[0]).limit(0), kind).collect()}
        assert found == {("missing_column", columns[0]), ("empty_data", None)}
    data = spark.createDataFrame([("P", e, "g", "s", "L", "1") for e in ("E1", "E2")], ", ".join(f"`{c}` string" for c in readers.MSSTATS_COLUMNS))
    assert validate.validate_inputs(design, data, "msstats").count() == 0


def test_run_with_annotation_files(spark, tmp_path):
    inter, design, preys = planted(spark, 1000.0)
    cells = {(r.prey, r.experiment): r.value for r in inter.collect()}
    names = [d[0] for d in DESIGN]
    write = lambda name, lines: (tmp_path / name).write_text("\n".join("\t".join(x) for x in lines) + "\n") and str(tmp_path / name)
    data = write("diann.tsv", [["Protein.Group", "Genes", *names], *[[f"P{p}", f"G{p}", *[str(cells.get((f"P{p}", e), "")) for e in names]] for p in range(20)]])
    (tmp_path / "design.csv").write_text("Experiment Name,Type,Bait,Replicate,Bait ID\n" + "".join(f"{e},{t},{b},{r},{i}\n" for e, b, i, t, r, _ in DESIGN))
    files = {
        "proteins": write("p.tsv", [["Entry", "Gene Names", "Subcellular location [CC]", "Gene Ontology (cellular component)"], *[[f"P{p}", f"G{p} S{p}", f"SUBCELLULAR LOCATION: {'Nucleus' if p % 2 else 'Cytosol'}.", f"x [GO:000000{1 + p % 2}]"] for p in range(20)]]),
        "atlas": write("a.tsv", [["Gene name", "Main location"], ["S1", "Nucleoplasm"], ["G2", "Cytosol"]]),
        "complexes": write("c.tsv", [["complex_name", "subunits_uniprot_id"], ["Cé", "P1;P2"]]),
        "physical": write("k.tsv", [[*readers.ANNOTATION_COLUMNS["physical"]], ["9606", "9606", "physical", "Y2H", "A", "s", "P3", "P0"], ["9606", "9606", "physical", "MS", "B", "t", "P3", "P0"], ["10090", "9606", "physical", "MS", "B", "t", "P4", "P0"]]),
        "multivalidated": write("m.tsv", [[*readers.ANNOTATION_COLUMNS["multivalidated"]], ["9606", "9606", "physical", "Y2H", "A", "s", "P3", "P0"]]),
    }
    (tmp_path / "o.obo").write_text("v\n\n" + "\n\n".join(f"[Term]\nid: GO:000000{k}\nnamespace: cellular_component\n" + ("is_a: GO:0000003\n" if k < 3 else "") for k in (1, 2, 3)))
    files["obo"] = str(tmp_path / "o.obo")
    out = {(r.prey, r.bait): r for r in pipeline.run(spark, "diann", data, str(tmp_path / "design.csv"), annotations=files, iterations=50).collect()}
    one, two, three, four = (out[f"P{p}", "B0"] for p in (1, 2, 3, 4))
    assert (one.atlas_location, two.atlas_location, three.atlas_location) == ("Nucleoplasm", "Cytosol", None) and one.location == "Nucleus"
    assert one.complex == two.complex and one.complex and three.complex is None
    assert (three.is_known, three.multivalidated, three.systems, four.is_known) == (True, True, "Y2H; MS", False)
    assert two.similarity == 1.0 and 0 < one.similarity < 1
    mouse = pipeline.run(spark, "diann", data, str(tmp_path / "design.csv"), annotations=files, organism="mouse")
    assert not {"complex", "atlas_location"} & {*mouse.columns} and not any(r.is_known for r in mouse.collect())
    known = annotate.summarise_known(*[readers.read_annotations(spark, k, files[k]) for k in ("physical", "multivalidated")], 9606)
    assert [tuple(r) for r in known.collect()] == [("P3", "P0", "Y2H; MS", "A; B", "s; t", True)]
    assert scoring.beta_of(0.5) == 0
