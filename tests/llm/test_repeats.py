"""Substring and suffix dedup against brute force."""

import random

import numpy as np
import pytest

from preyscope.llm import anchors, queries, substrings, suffixes

from .helpers import corpus, frame, prose, rows_of, run, sha, with_extra


def brute(rows, tokens, join, window):
    """id -> (tokens, removed, runs, digest); rows in order."""
    seen, out = set(), []
    for doc_id, text in rows:
        x = tokens(text or "")
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - window + 1):
            w = tuple(x[k : k + window])
            if w in seen:
                gone[k : k + window] = True
            seen.add(w)
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((doc_id, len(x), int(gone.sum()), runs, sha(join([t for t, g in zip(x, gone, strict=True) if not g]))))
    return out


def words(text):
    return text.encode().split()


CASES = [corpus(), corpus(2, 20), [], [None, "", None], ["one two"] * 5, [" ".join(map(str, range(25)))] * 9, ["x" * 500, "y" * 99, "x" * 100]]


@pytest.mark.parametrize("texts", CASES, ids=range(len(CASES)))
def test_words_and_bytes(spark, texts):
    rows = rows_of(texts)
    docs = frame(spark, rows)
    pairs = [(r[0], r[1]) for r in rows]
    expected = [(i, n, g, d) for i, n, g, _, d in brute(pairs, words, b" ".join, 20)]
    assert run(substrings.remove_duplicates(docs)) == sorted(expected, key=repr)
    expected = brute(pairs, lambda t: list(t.encode()), bytes, 100)
    assert run(suffixes.remove_duplicates(docs)) == sorted(expected, key=repr)


def test_repeated_and_null_ids_and_extra_columns(spark):
    rng = random.Random(5)
    a, b = prose(rng, 40), prose(rng, 50)
    rows = [(None, a, None, None, None), (3, a, None, None, None), (3, b, None, None, None), (3, b, None, None, None), (7, b + " " + a, None, None, None)]
    docs = with_extra(frame(spark, rows))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = [(i, n, g, d) for i, n, g, _, d in brute([(r[0], r[1]) for r in order], words, b" ".join, 20)]
    assert run(substrings.remove_duplicates(docs)) == sorted(expected, key=repr)
    assert run(suffixes.remove_duplicates(docs)) == sorted(brute([(r[0], r[1]) for r in order], lambda t: list(t.encode()), bytes, 100), key=repr)


def test_kept_texts_round_trip(spark):
    docs = frame(spark, rows_of(corpus(3, 20)))
    for r in substrings.remove_duplicates(docs, texts=True).collect():
        assert sha(r.kept) == r.kept_sha256
    for r in suffixes.remove_duplicates(docs, bytes_kept=True).collect():
        assert sha(bytes(r.kept)) == r.kept_sha256


def test_hot_grams_crowded_keys_and_split_texts(spark, monkeypatch):
    """The other routes give the same rows: nothing sampled as hot, everything crowded, texts in small pieces."""
    docs = frame(spark, rows_of(corpus(4, 40)))
    expected = run(substrings.remove_duplicates(docs)), run(suffixes.remove_duplicates(docs))
    monkeypatch.setattr(anchors, "HOT_DOCS", 10**9)
    assert (run(substrings.remove_duplicates(docs)), run(suffixes.remove_duplicates(docs))) == expected
    rows = anchors.numbered(docs)
    shape = anchors.Shape(100, 37)
    found = anchors.repeats(rows, suffixes.byte_hashes, shape)
    contested = found.where(f"kind = {anchors.CONTESTED}")
    alone = anchors.first_wins(anchors.windows_alone(rows, contested, suffixes.byte_hashes, shape), 100)
    by_bwt = suffixes.settle_collections(suffixes._pieces(rows, contested, shape), shape, size=8)

    def starts(df):
        return {(r.did, r.s + k) for r in df.collect() for k in range(r.c)}

    assert contested.count() and starts(alone) == starts(by_bwt)


def test_pieces_of_long_texts_agree():
    rng = random.Random(6)
    x = substrings.word_hashes(prose(rng, 4000, 50))
    shape = anchors.Shape(20, 8)

    def windows(piece):
        old, anchors.PIECE = anchors.PIECE, piece
        try:
            out = {}
            for h, _, base in anchors.hashed_pieces([1], [0], [x], shape):
                s = h.segments()
                for d, a, c, key in zip(s.doc, s.start, s.count, s.key, strict=True):
                    for k in range(c):
                        out[int(base[d] + a - h.bounds[d] + k)] = int(key)
            return out
        finally:
            anchors.PIECE = old

    whole = windows(1 << 20)
    assert len(whole) == len(x) - 19 and windows(100) == whole and windows(257) == whole


def plain_factors(blocks, window):
    """Greedy factors of each block in turn against all earlier ones, by comparing words at every place."""
    out = []
    for k, (did, s, x) in enumerate(blocks):
        p, end = 0, 0
        while p + window <= len(x):
            best = (0, None)
            for other, start, y in blocks[:k]:
                for q in range(len(y)):
                    n = 0
                    while p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
                        n += 1
                    if n >= window and n > best[0]:
                        best = (n, (other, start + q))
            if best[1] and p < end:
                out.append((did, s + p, window))
            elif best[1]:
                out.append((did, s + p, best[0]))
                end = p + best[0]
                p = end - window
            p += 1
    return out


def test_factors_against_a_plain_parser(spark, monkeypatch):
    monkeypatch.setattr(anchors, "HOT_DOCS", 10**9)
    rng = random.Random(9)
    texts = corpus(7, 30)
    for k in range(25):  # one passage with changes at many places
        x = prose(random.Random(3), 60).split(" ")
        x[rng.randrange(60)] = f"new{k}"
        texts.append(prose(rng, 5) + " " + " ".join(x) + " " + prose(rng, rng.randrange(9)))
    rows = anchors.numbered(frame(spark, rows_of(texts)))
    found = anchors.repeats(rows, substrings.word_hashes, anchors.Shape(20, 8))
    blocks = substrings._blocks(rows, found.where(f"kind = {anchors.CONTESTED}"), 20)
    by_key = {}
    for r in blocks.collect():
        by_key.setdefault(r.key, []).append((r.did, r.s, bytes(r.words).split(b" ")))
    expected = sorted(f for own in by_key.values() for f in plain_factors(sorted(own), 20))
    out = substrings.factors(blocks).collect()
    assert sorted((r.did, r.s, r.n) for r in out) == expected and len(expected) > 50
    split = {k: (t or "").encode().split() for k, t in enumerate(texts)}
    for r in out:
        assert (r.ref_did, r.ref_s) < (r.did, r.s) and split[r.did][r.s : r.s + r.n] == split[r.ref_did][r.ref_s : r.ref_s + r.n]
    assert max(r.n for r in out) > 20


def test_registered_queries_of_repeats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    pairs = [(r.doc_id, r.text) for r in docs]
    expected = [(i, n, g, d) for i, n, g, _, d in brute(pairs, words, b" ".join, 20)]
    assert run(queries.op6_substrings(spark, "/root/testdata/sf0.001")) == sorted(expected, key=repr)
    assert run(queries.op7_suffixes(spark, "/root/testdata/sf0.001")) == sorted(brute(pairs, lambda t: list(t.encode()), bytes, 100), key=repr)
