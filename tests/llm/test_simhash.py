import random

import pytest
import xxhash

from preyscope.llm import queries, simhash
from preyscope.llm.common import components

from .helpers import LOW, WORD, corpus, frame, rows_of, run, with_extra


def brute_print(text):
    words = WORD.findall((text or "").translate(LOW))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), seed=42) for k in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius=2):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_against_brute_force(spark):
    rows = rows_of(corpus())
    prints = {r[0]: brute_print(r[1]) for r in rows}
    groups = brute_groups(prints)
    expected = [(i, f"{prints[i]:016x}", groups[i]) for i in prints]
    assert run(simhash.near_duplicates(with_extra(frame(spark, rows)))) == sorted(expected, key=repr)


def test_masks_cover_every_pair_of_positions():
    for radius in (1, 2):
        masks = simhash.masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for a in range(64):
            for b in range(64):
                if radius == 2 or a == b:
                    assert any(not (m >> a) & 1 and not (m >> b) & 1 for m in masks)


@pytest.mark.parametrize("radius", [1, 2])
@pytest.mark.parametrize("group", [1, 12, 256])
def test_links_of_close_fingerprints(spark, radius, group):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = {*base}
    for x in base:  # chains of steps of one or two bits, and a crowd about one value
        for k in range(12):
            x ^= 1 << rng.randrange(64) | (1 << rng.randrange(64) if k % 3 else 0)
            prints.add(x)
    prints |= {base[0] ^ (1 << a) for a in range(64)}
    signed = [(simhash._signed(x),) for x in prints]
    links = simhash.covering_links(spark.createDataFrame(signed, "fp long"), radius, group).cache()
    groups = brute_groups({x: x for x in prints}, radius)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= radius for r in links.collect())
    first = {}
    for x, g in groups.items():
        first.setdefault(g, set()).add(x)
    found = {}
    for r in components(links).collect():
        found.setdefault(r.component, set()).add(r.node & (2**64 - 1))
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in first.values() if len(v) > 1)


def test_empty_null_and_repeated_rows(spark):
    assert run(simhash.near_duplicates(frame(spark, []))) == []
    rows = [(None, "a b c d", None, None, None), (4, "a b c d", None, None, None), (4, "a b c d", None, None, None), (2, None, None, None, None), (1, "", None, None, None)]
    out = run(simhash.near_duplicates(frame(spark, rows)))
    assert [(r[0], r[2]) for r in out] == sorted([(1, 1), (2, 1), (4, 4), (4, 4), (None, 4)], key=repr)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (500, 500), (None, 3)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 500: 500}


def test_registered_query_and_hot_fingerprints(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    prints = {r.doc_id: brute_print(r.text) for r in docs}
    groups = brute_groups(prints)
    expected = sorted([(i, f"{prints[i]:016x}", groups[i]) for i in prints], key=repr)
    assert run(queries.op1_simhash(spark, "/root/testdata/sf0.001")) == expected
    monkeypatch.setattr(simhash, "HOT", 1)
    assert run(queries.op1_simhash(spark, "/root/testdata/sf0.001")) == expected
