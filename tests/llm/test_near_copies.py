import random

import numpy as np
import pytest

import corpus_pipeline
from preyscope.llm import mixing, near_copies
from preyscope.llm.common import documents

from .helpers import WORD, frame, prose, run

SF = "/root/testdata/sf0.001"


def sets(text, n=5):
    words = WORD.findall((text or "").lower())
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


def alike(a, b):
    return len(a & b) / len(a | b)


def planted(seed, header=""):
    """Texts, copies of similarity from below 0.8 to 0.97, a chain and a large family."""
    rng = random.Random(seed)
    texts = [header + prose(rng, rng.choice([4, 30, 150, 400]), 5000) for _ in range(60)]
    for k in range(60):
        words = texts[k].split(" ")
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8])):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    for _ in range(40):  # each is near the first, few are near each other
        words = texts[3].split(" ")
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    words = prose(rng, 300, 5000).split(" ")
    for k in range(12):
        words[20 * k + 10] = f"step{k}"
        words[20 * k + 15] = f"step{k}"
        texts.append(" ".join(words))
    return texts


def brute(texts):
    own, root = [sets(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = []
    for a in range(len(texts)):
        for b in range(a):
            if (s := alike(own[a], own[b])) >= 0.8:
                near.append(s)
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(k) for k in range(len(texts))}, near


@pytest.mark.parametrize("header", ["", " ".join(f"h{k}" for k in range(120)) + " "])
def test_stage_keeps_one_of_each_group_of_0_8(spark, header):
    texts = planted(5, header)
    kept, near = brute(texts)
    assert sum(0.8 <= s < 0.9 for s in near) > 20 and sum(0.9 <= s < 0.95 for s in near) > 5
    docs = frame(spark, [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)])
    assert {r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, SF).collect()} == kept


def test_rows_without_an_id_or_with_a_shared_one_stay(spark):
    rng = random.Random(1)
    a, b, c, d = (prose(rng, 40) for _ in range(4))
    rows = [(None, a), (None, b), (7, b), (5, c), (5, d), (5, d), (6, d.upper()), (9, None), (8, "")]
    docs = frame(spark, [(k, t, "en", "s", None) for k, t in rows])
    out = corpus_pipeline.deduplicate(spark, docs, SF).select("doc_id", "text")
    assert run(out) == sorted([(None, a), (7, b), (5, c), (5, d), (8, "")], key=repr)


def test_mix_of_rows_that_share_an_id(spark):
    rng = random.Random(1)
    rows = [(5, prose(rng, 40), "en", "a", None), (5, prose(rng, 30), "en", "b", None), (None, prose(rng, 20), "en", "a", None), (None, prose(rng, 25), "en", "c", None)]
    docs = frame(spark, rows)
    taken = sum(r.taken for r in mixing.mix(docs).collect())
    out = corpus_pipeline.mix(spark, docs, SF).collect()
    assert sum(len(WORD.findall(r.text)) for r in out) == taken > 100


def test_bands_find_alike_sets():
    """A pair of similarity s shares a band of five minima with a chance of s^5: the share of bands is near that."""
    rng = np.random.default_rng(2)
    shares = []
    for _ in range(60):
        both, one, two = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (400, 50, 50))
        a, b = (near_copies.bands(np.unique(np.concatenate([both, x]))) for x in (one, two))
        shares.append((a == b).mean())
    assert all(x > 0 for x in shares) and abs(np.mean(shares) - 0.8**5) < 0.04
    assert (near_copies.bands(both) == near_copies.bands(both[::-1])).all() and len(near_copies.bands(both)) == near_copies.BANDS


def test_stage_on_the_test_table(spark):
    docs = documents(spark, SF)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    kept, _ = brute([r.text for r in rows])
    assert {r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, SF).collect()} == {rows[k].doc_id for k in kept}


@pytest.mark.parametrize("n", [150, 600])
def test_templates_are_no_candidates(spark, n):
    """Texts that share three quarters of their words are alike by about 0.6: hardly a pair of them is verified."""
    rng = random.Random(n)
    common = [prose(rng, 30, 5000) for _ in range(10)]
    docs = frame(spark, [(k, "\n".join(c + " " + prose(rng, 6, 10**6) for c in common), "en", "s", None) for k in range(n)])
    texts = near_copies._keyed(docs)
    own = [near_copies.shingles(r.text) for r in texts.limit(2).collect()]
    assert 0.4 < len(np.intersect1d(*own)) / len(np.union1d(*own)) < 0.75
    led = near_copies._led(near_copies._postings(texts, 5), 0.8)
    open_ = led.selectExpr("g", "key", "n", "key as of", f"{4 * near_copies.BLOCK}L as rows")
    pairs = near_copies._between(open_, near_copies._sketches(texts, texts.select("key"), 5), 0.8)
    assert led.count() > n and pairs.count() <= n
    assert near_copies.near_copies(docs).count() == 0


def test_sketches_tell_similarities():
    rng = np.random.default_rng(7)
    for both, low, high in ((400, 0.73, 0.9), (240, 0.3, 0.68)):
        shares = []
        for _ in range(30):
            a, b = (np.unique(np.concatenate([own, rng.integers(0, 1 << 63, 500 - both - (500 - both) // 2).astype(np.uint64)])) for own in [rng.integers(0, 1 << 63, both).astype(np.uint64)] * 2)
            shares.append((near_copies.sketch(a) == near_copies.sketch(b)).mean())
        assert low < min(shares) and max(shares) < high


def test_the_row_that_stays_is_defined(spark):
    rng = random.Random(2)
    text = prose(rng, 40)
    rows = [(4, text, "en", source, n) for source, n in (("b", 1), ("a", 2), ("a", 1), ("c", 0))] + [(4, text, None, "z", 3)]
    for parts in (1, 4):
        out = near_copies.keep_one(frame(spark, rows[::-1]).repartition(parts)).collect()
        assert [tuple(r) for r in out] == [(4, text, "en", "a", 1)]
    assert near_copies.keep_one(frame(spark, [])).collect() == []


def test_families_without_a_leader_cost_a_row_a_text(spark):
    rng = random.Random(5)
    words = prose(rng, 400, 5000).split(" ")
    texts = []
    for _ in range(200):
        own = list(words)
        own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    keyed = near_copies._keyed(frame(spark, [(k, t, "en", "s", None) for k, t in enumerate(texts)]))
    led = near_copies._led(near_copies._postings(keyed, 5), 0.8)
    open_ = led.selectExpr("1L as g", "key", "n", "key as of", "200L as rows").distinct()
    pairs = near_copies._between(open_, near_copies._sketches(keyed, keyed.select("key"), 5), 0.8).collect()
    root = {k: k for r in pairs for k in r}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    assert len(root) == open_.count() and len({find(x) for x in root}) == 1 and len(pairs) < 2 * len(root)


def test_pairs_that_the_sketch_leaves_open_are_no_rows(spark):
    """Texts around one template that are alike by 0.74 to 0.82: pairs are open, the right ones join, rows are few."""
    rng = random.Random(6)
    words = prose(rng, 400, 5000).split(" ")
    texts = []
    for k in range(100):
        own = list(words)
        for at in rng.sample(range(10, 390), 4 if k % 5 == 0 else 6):
            own[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    kept, near = brute(texts)
    assert len(near) > 10 and 10 < len(kept) < 90
    docs = frame(spark, [(k, t, "en", "s", None) for k, t in enumerate(texts)])
    keyed = near_copies._keyed(docs)
    led = near_copies._led(near_copies._postings(keyed, 5), 0.8)
    open_ = led.selectExpr("1L as g", "key", "n", "key as of", "100L as rows").distinct()
    assert near_copies._between(open_, near_copies._sketches(keyed, keyed.select("key"), 5), 0.8).count() <= 2 * len(texts)
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == kept
