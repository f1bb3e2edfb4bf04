import inspect

from preyscope.plans import queries


def test_registered_with_production_rounds():
    assert "rounds=500, stable=50" in inspect.getsource(queries.affinity_clusters)
    assert "rounds=2" not in inspect.getsource(queries.topology_scores)
