"""The conversation trie against nested dictionaries, and its blocks and merges by themselves."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from preyscope.llm import conversation_trie as ct
from preyscope.llm import queries

from .helpers import WORD, run, sha

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuild(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c > 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain(rows):
    """All nodes by brute force over all prefixes."""
    nodes, convs = {}, rebuild(rows)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    ends = {}
    for c, turns in convs.items():
        ends.setdefault(tuple(turns), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for key, members in nodes.items():
        if key:
            kids[key[:-1]] = kids.get(key[:-1], 0) + 1
    for key, members in nodes.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] = leaves.get(key[:d], 0) + (key not in kids)
            saved[key[:d]] = saved.get(key[:d], 0) + ((len(members) - 1) * len(re.findall(WORD, key[-1][1])) if key else 0)
    return sorted(
        (
            (min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids.get(k, 0), leaves[k], saved[k], sha(",".join(map(str, sorted(ends.get(k, []))))))
            for k, m in nodes.items()
        ),
        key=repr,
    )


def drawn(seed, n, letters=2, longest=6, spread=1):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.randrange(1, longest)):
            rows.append((spread * c - 7, turn, rng.choice(["user", "bot"]) if rng.random() < 0.2 else "user", "say " * rng.randrange(1, letters + 1)))
    return rows


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def grown(paths, sizes):
    """Nodes of sorted paths (lists of small numbers), cut into blocks of the given sizes and merged in a random tree."""
    rng = random.Random(len(paths))
    rows, forests, at = ct.Rows(), [], 0
    for k, size in enumerate(sizes):
        part = paths[at : at + size]
        if part:
            forests.append(ct.grow([p for p, _ in part], [c for _, c in part], [[b for b in p[15::16]] for p, _ in part], rows, 0, k))
        at += size
    while len(forests) > 1:
        k = rng.randrange(len(forests) - 1)
        row = [ct._packed(f, 0) for f in forests[k : k + 2]]
        forests[k : k + 2] = [ct.merge(*map(ct._unpacked, row), rows)]
    ct.finish(forests[0], rows)
    nodes = [r for r in rows.rows if r["kind"] == ct.NODE]
    by_key = {r["key"]: r["conv_id"] for r in nodes if r["key"]}
    pieces = {}
    for r in sorted((r for r in rows.rows if r["kind"] == ct.ENDS), key=lambda r: r["at"]):
        pieces.setdefault(r["key"], []).append(r["ends"])
    ends = {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in pieces.items()}
    return sorted(
        ((r["conv_id"], r["depth"], by_key[r["up"]] if r["up"] else r["parent"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], ends.get(r["key"], ct.NOTHING) if r["key"] else r["ends"]) for r in nodes),
        key=repr,
    )


@pytest.mark.parametrize("seed", range(40))
def test_blocks_and_merges(seed):
    rng = random.Random(seed)
    n = rng.choice([1, 2, 3, 10, 60])
    letters = rng.choice([1, 2, 4])
    turns = [[rng.randrange(letters) for _ in range(rng.randrange(rng.choice([1, 3, 7])))] for _ in range(n)]
    paths = sorted((b"".join(x.to_bytes(16, "big") for x in t), c) for c, t in enumerate(turns))
    whole = grown(paths, [n])
    nodes = {}
    for p, c in paths:
        for d in range(len(p) // 16 + 1):
            nodes.setdefault(p[: 16 * d], []).append(c)
    assert sorted((min(m), len(k) // 16, len(m)) for k, m in nodes.items()) == sorted((r[0], r[1], r[3]) for r in whole)
    for _ in range(4):
        sizes = []
        while sum(sizes) < n:
            sizes.append(rng.randrange(1, max(2, n // 2)))
        assert grown(paths, sizes) == whole


@pytest.mark.parametrize(("seed", "n", "letters", "spread"), [(1, 120, 2, 1), (2, 90, 1, 1), (3, 150, 5, 3), (4, 1, 2, 1), (5, 2, 1, 20)])
def test_rows(spark, seed, n, letters, spread):
    rows = drawn(seed, n, letters, spread=spread)
    rows += [(5, None, "user", None), (6, None, None, "x"), (None, 1, "user", "nobody's"), (23, 99, "user", "a longer turn " * 2000)]
    df = frame(spark, rows).selectExpr("*", "1 as base", "2 as path", "3 as depth", "'x' as key")
    assert run(ct.trie(df)) == plain(rows)


def test_copies_over_many_partitions_and_rounds(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(900) for t in range(4)] + [(2000 + c, t, "user", f"same {t if t < 3 else c}") for c in range(200) for t in range(5)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(ct.trie(frame(spark, rows))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_turns_turnless_conversations_and_long_ones(spark):
    assert run(ct.trie(frame(spark, []))) == []
    # Conversations whose few turns are all before their lent head, of which there is none, have no turns.
    few = [(c, 0, "user", "hi") for c in range(21, 39)]
    found = run(ct.trie(frame(spark, few)))
    assert found == plain(few) and any(r[1] == 0 and r[7] != ct.NOTHING for r in found)
    again = [(c, 1, "user", "hi") for c in (0, 1, 2, 3) for _ in range(3)]
    assert run(ct.trie(frame(spark, again))) == plain(again)
    long = [(c, t, "user", f"{t if c else min(t, 100)} words") for c in (0, 40) for t in range(150)]
    assert run(ct.trie(frame(spark, long))) == plain(long)


def test_registered_query(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        found = run(queries.op12_conversation_trie(spark, folder))
        assert found == plain(rows)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{folder}/conversations.parquet')")
    assert sorted(map(tuple, con.execute(queries.ORACLE["op12_conversation_trie"]).fetchall()), key=repr) == found
