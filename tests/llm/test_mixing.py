import random

import pytest

from preyscope.llm import mixing

from .helpers import WORD, corpus, frame, prose, rows_of, run, with_extra


def brute_targets(sizes):
    """Sources by code point, null last, by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    open_, target, left = {*order}, {}, float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check(rows, out):
    size = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    target = brute_targets(sizes)
    assert sorted((r.doc_id, r.source, r.size) for r in out) == sorted((r[0], r[3], size(r[1])) for r in rows) if all(r[3] for r in rows) else len(out) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source], rel=1e-9)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1


@pytest.mark.parametrize("slots", [40, 1 << 20])
def test_targets_and_takes(spark, slots):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(60)) for _ in range(200)] + [None, "", " \n"]
    rows = rows_of(texts, lambda k: "big" if k < 120 else [None, "a", "ä", "z", "B"][k % 5])
    docs = with_extra(frame(spark, rows))
    out = mixing.mix(docs, slots=slots).collect()
    check(rows, out)
    assert run(mixing.mix(docs.repartition(7), slots=slots)) == sorted(map(tuple, out), key=repr)


def test_schedule_interleaves(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 1000), ("c", 1000)], "source string, size long")
    slots = [r for r in mixing.schedule(mixing._goals(sizes, 3000)).collect() if r.slot is not None]
    order = [r.rank for r in sorted(slots, key=lambda r: r.slot)]
    for n in (16, 100, 1000):  # each stretch of the schedule has the sources' shares
        for rank, share in enumerate((5 / 8, 2 / 8, 1 / 8)):
            assert abs(order[:n].count(rank) - share * n) <= 3


def test_edge_tables(spark):
    assert run(mixing.mix(frame(spark, []))) == []
    assert [(r.size, r.taken, r.target) for r in mixing.mix(frame(spark, [(1, None, None, None, None)])).collect()] == [(0, 0, 0.0)]
    one = mixing.mix(frame(spark, [(1, "a b", None, None, None), (1, "a b", None, None, None)])).collect()
    assert [(r.taken, r.target) for r in one] == [(2, 4.0)] * 2


def test_repeat(spark):
    rows = rows_of([t for t in corpus(1, 30)])
    docs = frame(spark, rows)
    plan = mixing.mix(docs)
    out = mixing.repeat(docs, plan).collect()
    text, got = {r[0]: r[1] for r in rows}, {}
    for r in out:
        assert text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert got == {r.doc_id: r.taken for r in plan.collect() if r.taken}
