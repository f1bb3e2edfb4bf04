"""semantic_pairs answers for every scored pair, however low its score."""

import random

import pytest

from preyscope.functions import stats
from preyscope.operators import ontology
from preyscope.plans import queries


def tables(spark, folder):
    # Baits 1 and 2 (tests) and 8 (a control); parts 1 to 4; few pieces of most, so that their scores are low.
    lines = [(1, 1, 1, 2.0), (1, 2, 1, 500.0), (2, 3, 2, 1.0), (2, 2, 2, 90.0), (3, 4, 2, 3.0), (3, 4, 8, 900.0)]
    spark.createDataFrame([(*x, 10.0) for x in lines], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{folder}/lineitem.parquet")
    parts = [(1, "STEEL", "B1", "red lime"), (2, "STEEL", "B2", "red blue"), (3, "TIN", "B1", "green blue"), (4, "TIN", "B2", "lime blue")]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_brand string, p_name string").write.parquet(f"{folder}/part.parquet")


def test_pairs_of_low_scores(spark, tmp_path):
    tables(spark, tmp_path)
    scores = {(r.bait_id, r.prey): r.score for r in queries.scored_view(spark, str(tmp_path)).collect()}
    assert sum(s < 0.6 for s in scores.values()) == 3 and len(scores) == 5
    got = {(r.bait_id, r.first_id): r.similarity for r in queries.semantic_pairs(spark, str(tmp_path)).collect()}
    assert got.keys() == scores.keys() and got["P1", "P1"] == 1 and all(0 <= s <= 1 for s in got.values())


def test_sql_has_no_cut_either():
    assert "0.6" not in queries.ORACLE["semantic_pairs"].partition("gp as")[2]


def plain_similarity(values, genes, a, b):
    """Mean over the terms of both sides of their best match on the other; a term of both sides has the larger best."""
    of = {}
    for term, ancestor, v in values:
        of.setdefault(term, {})[ancestor] = v
    x, y = ({t for g, t in genes if g == side and t in of} for side in (a, b))
    if not x or not y:
        return None
    like = lambda p, q: sum(of[p][c] + of[q][c] for c in of[p].keys() & of[q].keys()) / (sum(of[p].values()) + sum(of[q].values()))
    one, two = {t: max(like(t, q) for q in y) for t in x}, {t: max(like(p, t) for p in x) for t in y}
    best = [max(s, two.get(t, s)) for t, s in one.items()] + [max(s, one.get(t, s)) for t, s in two.items()]
    return sum(best) / len(best)


@pytest.mark.parametrize("few", [100_000, 0])
def test_similarity_with_few_and_with_many_genes(spark, monkeypatch, few):
    monkeypatch.setattr(stats, "MOST_VALUES", few)
    rng = random.Random(3)
    values = [(f"T{t}", f"T{t}", 1.0) for t in range(12)] + [(f"T{t}", f"T{u}", round(rng.random(), 3)) for t in range(12) for u in range(t) if rng.random() < 0.4]
    genes = sorted({(f"G{rng.randrange(15)}", f"T{rng.randrange(14)}") for _ in range(50)}) + [("G0", None), (None, "T1")]
    pairs = sorted({(f"G{rng.randrange(4)}", f"G{rng.randrange(17)}") for _ in range(60)})
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    closure = df([("n", *v) for v in values], "namespace string, term string, ancestor string, value double")
    out = ontology.gene_similarity(closure, df(genes + genes, "gene string, term string"), df(pairs + pairs[:5] + [(None, "G1"), ("G1", None)], "a string, b string"), digits=6).collect()
    want = {(a, b): s for a, b in pairs if (s := plain_similarity(values, genes, a, b)) is not None}
    assert len(out) == len(want) and all(r.similarity == pytest.approx(want[r.a, r.b], abs=1e-6) for r in out)


def test_pairs_move_once(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    closure = df([("n", "T1", "T1", 1.0), ("n", "T2", "T2", 1.0)], "namespace string, term string, ancestor string, value double")
    out = ontology.gene_similarity(closure, df([("A", "T1"), ("B", "T2")], "gene string, term string"), df([("A", "B")], "a string, b string"))
    # The pairs and the terms of b; what they make stays where it is.
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert out.first().similarity == 0
