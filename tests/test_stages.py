"""Runs that are stopped go on without fitting again, and leave results only."""

import csv
import glob
import json
import os

import pytest

from preyscope.plans import pipeline, stages
from preyscope.operators import impute, score_intensity

from .test_tables import DESIGN, planted


@pytest.fixture
def files(spark, tmp_path):
    inter, _, _ = planted(spark, 1000.0)
    cells = {(r.prey, r.experiment): r.value for r in inter.collect()}
    names = [d[0] for d in DESIGN]
    lines = [["Protein.Group", "Genes", *names], *[[f"P{p}", f"G{p}", *[str(cells.get((f"P{p}", e), "")) for e in names]] for p in range(20)]]
    (tmp_path / "diann.tsv").write_text("\n".join("\t".join(x) for x in lines) + "\n")
    for name, group in (("plain", None), ("grouped", {"T": "1", "C": "*"})):
        head = "Experiment Name,Type,Bait,Replicate,Bait ID" + ",Group" * bool(group)
        (tmp_path / f"{name}.csv").write_text(head + "\n" + "".join(f"{e},{t},{b},{r},{i or ''}" + (f",{group[t]}" if group else "") + "\n" for e, b, i, t, r, _ in DESIGN))
    return tmp_path


def left(folder):
    return sorted(os.path.relpath(p, folder) for p in glob.glob(f"{folder}/**", recursive=True, include_hidden=True) if os.path.isdir(p) and os.path.relpath(p, folder) != ".")


def test_a_stopped_run_goes_on(spark, files, monkeypatch):
    args = (spark, str(files / "out"), "one", "diann", str(files / "diann.tsv"), str(files / "plain.csv"))
    how = {"imputation": "mixture", "pi": 0.1, "rounds": 2}
    with monkeypatch.context() as stopped:
        stopped.setattr(score_intensity, "score", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            pipeline.run_to(*args, **how)
    folder = str(files / "out" / "one")
    assert os.path.exists(f"{folder}/stages/imputed/{stages.MANIFEST}") and not os.path.exists(f"{folder}/results")
    with monkeypatch.context() as refit:
        refit.setattr(impute, "impute", lambda *a, **k: pytest.fail("fitted again"))
        path = pipeline.run_to(*args, **how)
    assert left(folder) == ["results", "results/scores", "results/scores_csv", "results/wd_input"]
    about = json.load(open(f"{path}/{stages.MANIFEST}"))
    whole = sorted(map(tuple, pipeline.run(spark, "diann", args[4], args[5], **how).collect()), key=repr)
    assert sorted(map(tuple, spark.read.parquet(f"{path}/scores").collect()), key=repr) == whole and about["rows"] == len(whole) and about["parameters"]["pi"] == 0.1
    with open(glob.glob(f"{path}/wd_input/*.csv")[0]) as f:
        assert next(csv.reader(f)) == ["Experiment.ID", "Replicate", "Bait", "Prey", "Prey.Name", "Spectral.Count"]
    with pytest.raises(ValueError, match="name_in_use"):
        pipeline.run_to(*args, **how)
    with pytest.raises(ValueError, match="invalid_name"):
        pipeline.run_to(args[0], args[1], "one/two", *args[3:])


def test_groups_are_published(spark, files):
    path = pipeline.run_to(spark, str(files / "out"), "two", "diann", str(files / "diann.tsv"), str(files / "grouped.csv"), rounds=2)
    assert left(path) == ["groups", "groups/source_group=1", "scores", "scores_csv", "summary", "wd_input"]
    summary = spark.read.json(f"{path}/summary").first()
    assert (summary.source_group, summary.n_pairs) == (1, spark.read.parquet(f"{path}/scores").count())


def test_stages_follow_their_inputs(spark, files):
    folder, calls = str(files / "stages_only"), []

    def build(n):
        def table():
            calls.append(n)
            return spark.range(n)

        return table

    for parameters, counts in (({"a": 1}, [2, 3]), ({"a": 1}, [2, 3]), ({"a": 2}, [2, 3])):
        run = stages.StagedRun(spark, folder, parameters, [str(files / "plain.csv")])
        assert [run.stage(f"s{n}", build(n)).count() for n in counts] == counts
    assert calls == [2, 3, 2, 3]
    (files / "plain.csv").write_text("changed")
    again = stages.StagedRun(spark, folder, {"a": 2}, [str(files / "plain.csv")])
    again.stage("s2", build(2))
    assert calls == [2, 3, 2, 3, 2] and again.made == ["s2"]
    with pytest.raises(RuntimeError, match="no table"):
        again.stage("s9", lambda: (_ for _ in ()).throw(RuntimeError("no table")))
    assert "s9" not in os.listdir(f"{folder}/stages")
