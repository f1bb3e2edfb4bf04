import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

import corpus_pipeline
from preyscope.llm import mixing, queries

from .helpers import WORD, frame, prose, rows_of

SF = "/root/testdata/sf0.001"


def interleaved(sources, words, shares):
    """The largest distance of a source's words from its share in any stretch from the start."""
    done, total, worst = dict.fromkeys(shares, 0), 0, 0.0
    for s, n in zip(sources, words, strict=True):
        done[s] += n
        total += n
        worst = max(worst, *(abs(done[x] - shares[x] * total) for x in shares))
    return worst


def test_the_mix_comes_interleaved(spark):
    rng = random.Random(2)
    rows = rows_of([prose(rng, rng.randrange(1, 40)) for _ in range(300)])
    docs = frame(spark, rows)
    plan = {r.doc_id: r for r in mixing.mix(docs, slots=500).collect()}
    total = sum(r.taken for r in plan.values())
    shares = {s: sum(r.taken for r in plan.values() if r.source == s) / total for s in ("s0", "s1", "s2")}
    out = mixing.stream(docs, slots=500).collect()
    assert [r.slot for r in out] == sorted(r.slot for r in out)
    assert interleaved([r.source for r in out], [r.words for r in out], shares) < 0.03 * total
    got = {}
    for r in out:
        assert 0 <= r["from"] and r["from"] + r.words <= plan[r.doc_id].size
        got[r.doc_id] = got.get(r.doc_id, 0) + r.words
    assert got == {k: r.taken for k, r in plan.items() if r.taken}
    for r in plan.values():  # a slot for each copy
        assert len(r.slots) == -(-r.taken // r.size) and r.slots == sorted(r.slots)
    first = {}
    for r in out:
        if r["from"] == 0:
            first.setdefault(r.doc_id, []).append(r.slot)
    assert first == {k: r.slots for k, r in plan.items() if r.taken}


def test_the_stage_writes_rows_in_order(spark):
    rng = random.Random(2)
    docs = frame(spark, rows_of([prose(rng, rng.randrange(1, 40)) for _ in range(300)]))
    out = corpus_pipeline.mix(spark, docs, "").collect()  # in order of partitions
    words = [len(WORD.findall(r.text)) for r in out]
    shares = {s: sum(w for r, w in zip(out, words, strict=True) if r.source == s) / sum(words) for s in ("s0", "s1", "s2")}
    assert interleaved([r.source for r in out], words, shares) < 0.03 * sum(words)


def plain_targets(sizes):
    """Water filling: sources that would pass three times their size stop there, and the rest is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = Fraction(sum(sizes.values())), {*names}, {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= 3 * sizes[s]}
        if not full:
            return out | {s: share * weight[s] for s in open_}
        out |= {s: Fraction(3 * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def plain_mix(rows, slots):
    """doc_id -> words taken, slot by slot; rows (doc_id, source, size, hash that orders a source's documents)."""
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    targets, names = plain_targets(sizes), sorted(sizes, key=lambda s: (s is None, s or ""))
    total, at, low, taken = sum(sizes.values()), Fraction(0), 0, {r[0]: 0 for r in rows}
    length = max(1, -(-total // slots))
    plan = {}
    for s in names:
        at += targets[s]
        high = round(at / (sum(targets.values()) or 1) * 2**32)
        take, blocks = min(math.floor(targets[s] + Fraction(1, 2)), 3 * sizes[s]), -(-sizes[s] // length)
        needs = take // sizes[s] * blocks + -(-(take % sizes[s]) // length) if sizes[s] else 0
        plan[s] = {"low": low, "high": high, "take": take, "blocks": blocks, "needs": needs, "k": 0}
        low = high
    order = []
    for slot in range(sum(p["needs"] for p in plan.values())):
        point = slot * 2654435769 % 2**32
        s = next(s for s in names if plan[s]["low"] <= point < plan[s]["high"])
        order.append(s)
    for s in names:
        order += [s] * plan[s]["needs"]  # what the points left out
    streams = {s: sorted((r for r in rows if r[1] == s and r[2]), key=lambda r: r[3] % 2**64) for s in names}
    for s in order:
        p = plan[s]
        if p["k"] == p["needs"]:
            continue
        turn, block = divmod(p["k"], p["blocks"])
        p["k"] += 1
        first = block * length
        last = first + min(length, sizes[s] - first, p["take"] - turn * sizes[s] - first)
        start = 0
        for i, _, n, _ in streams[s]:
            taken[i] += max(0, min(last, start + n) - max(first, start))
            start += n
    return taken, targets, sizes


def test_words_taken_against_a_plain_schedule(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = docs.select("doc_id", "source", "text", F.xxhash64(F.lit(7), "doc_id").alias("h")).collect()
    rows = [(r.doc_id, r.source, len(WORD.findall(r.text or "")), r.h) for r in own]
    for out, slots in ((queries.op9_mixing(spark, SF), mixing.SLOTS), (mixing.mix(docs, slots=700), 700)):
        taken, targets, sizes = plain_mix(rows, min(slots, 1 << 20))
        found = {r.doc_id: r for r in out.collect()}
        assert {i: r.taken for i, r in found.items()} == taken
        for i, s, n, _ in rows:
            assert (found[i].size, found[i].source_size) == (n, sizes[s]) and abs(found[i].target - float(targets[s])) < 1e-6 * sizes[s]


def test_rows_with_nulls_in_different_columns_and_ties(spark):
    rows = [(4, None, "en", "x", None), (4, "x", "en", None, 1), (7, "a b c d", "fr", "s", 7), (7, "a b c d", "en", "s", 7), (None, "q r", "en", "s", 3)]
    rows += [(k, "w " * 40, "en", "s", 80) for k in range(20, 30)]
    docs = frame(spark, rows)
    plan = mixing.mix(docs.withColumn("row", F.monotonically_increasing_id()), row="row")
    assert plan.where("doc_id = 4").count() == 2
    out = mixing.mix_rows(docs).collect()
    assert all(r.text is not None for r in out) and any((r.doc_id, r.text, r.source) == (4, "x", None) for r in out)
    assert {r.lang for r in out if r.doc_id == 7} <= {"en"}
