"""Semantic values over random ontologies against a plain recursion."""

import functools
import os

import numpy as np
import pytest

from preyscope.functions.lineage import shared_folder
from preyscope.operators import ontology


def test_random_ontologies(spark):
    rng = np.random.default_rng(6)
    edges = []
    for space in ("x", "y"):
        for child in range(1, 40):
            for parent in rng.choice(child, min(child, int(rng.integers(1, 4))), replace=False):
                edges += [(space, f"T{child:02}", f"T{parent:02}", str(rng.choice(["isa", "partof"])))] * int(rng.integers(1, 3))
    edges.append(("x", "T05", "T05", "isa"))
    children = {}
    for space, child, parent, _ in {*edges}:
        children.setdefault((space, parent), []).append(child)
    rows = [(*e, len(children[e[0], e[2]])) for e in edges]
    weight = {}
    for space, child, parent, kind, n in rows:
        w = 1 / (ontology.OFFSET + n) + ontology.KIND_WEIGHT[kind]
        weight[space, child, parent] = max(w, weight.get((space, child, parent), 0))

    @functools.cache
    def values(space, term):
        out = {term: 1.0}
        for (s, child, parent), w in weight.items():
            if (s, child) == (space, term) and parent != child:
                for ancestor, v in values(space, parent).items():
                    out[ancestor] = max(out.get(ancestor, 0), v * w)
        return out

    df = spark.createDataFrame(rows, "namespace string, child string, parent string, kind string, n_children long").repartition(4)
    got = ontology.semantic_values(df).collect()
    expected = {(s, t, a): v for s in ("x", "y") for t in {f"T{k:02}" for k in range(40)} for a, v in values(s, t).items()}
    assert len(got) == len(expected) and {(r.namespace, r.term, r.ancestor): r.value for r in got} == pytest.approx(expected)
    assert not [x for x in os.listdir(shared_folder(spark).removeprefix("file:")) if x.startswith("work-")] and not spark.catalog.listTables()


def test_cycles_deep_chains_and_no_edges(spark):
    schema = "namespace string, child string, parent string, kind string, n_children long"
    ring = [("x", "A", "B", "isa", 1), ("x", "B", "C", "isa", 1), ("x", "C", "A", "isa", 1), ("x", "D", "A", "isa", 1)]
    with pytest.raises(ValueError, match="own ancestors"):
        ontology.semantic_values(spark.createDataFrame(ring, schema))
    chain = [("x", f"C{k:02}", f"C{k + 1:02}", "isa", 1) for k in range(12)]
    got = {(r.term, r.ancestor): r.value for r in ontology.semantic_values(spark.createDataFrame(chain, schema)).collect()}
    w = 1 / (ontology.OFFSET + 1) + ontology.KIND_WEIGHT["isa"]
    assert len(got) == 13 * 14 // 2 and got["C00", "C12"] == pytest.approx(w**12)
    with pytest.raises(RuntimeError, match="levels"):
        ontology.semantic_values(spark.createDataFrame(chain, schema), most=3)
    assert ontology.semantic_values(spark.createDataFrame([], schema)).collect() == []
