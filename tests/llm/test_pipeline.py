"""Fingerprints and the pipeline, stage by stage, against brute force."""

import random

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from preyscope.functions.lineage import Workspace
from preyscope.llm import edit_embedding, langid, mixing, pii, queries
from preyscope.llm.common import documents

from .helpers import LOW, WORD, corpus, frame, prose, rows_of, run, sha, with_extra


def test_fingerprints_with_next(spark, monkeypatch):
    rows = rows_of([t for t in corpus(1, 20)])
    expected = {}
    for k, r in enumerate(rows):
        text, other = r[1] or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 2
        changed = text[: len(text) - n] + other[:n]
        a, b, c = edit_embedding.fingerprints([text, changed, other])
        expected[r[0]] = (len(text), sha(changed), a, b, edit_embedding.likeness(a, b), edit_embedding.likeness(a, c))
    docs = with_extra(frame(spark, rows))
    out = {r.doc_id: tuple(r)[1:] for r in edit_embedding.compare_with_next(docs).collect()}
    assert out == expected
    by_text = {}
    for r in rows:
        by_text.setdefault(r[1] or "", set()).add(expected[r[0]][2])
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprint_edges(spark):
    assert run(edit_embedding.compare_with_next(frame(spark, []))) == []
    (one,) = edit_embedding.compare_with_next(frame(spark, [(5, "abcd", None, None, None)])).collect()
    assert one.edited_sha256 == sha("abab") and one.near_next == 1.0
    rows = [(None, "xy", None, None, None), (2, None, None, None, None), (2, "pqrs", None, None, None)]
    out = sorted(map(tuple, edit_embedding.compare_with_next(frame(spark, rows)).select("doc_id", "n_chars", "edited_sha256").collect()), key=repr)
    assert out == sorted([(None, 2, sha("x")), (2, 0, sha("")), (2, 4, sha("pqxy"))], key=repr)


def test_likeness_falls_with_edits():
    rng = random.Random(1)
    text = prose(rng, 800)
    some = list(text)
    near = []
    for edits in (0, 4, 40, 400):
        for _ in range(edits):
            some[rng.randrange(len(some))] = rng.choice("abcdef")
        a, b = edit_embedding.fingerprints([text, "".join(some)])
        near.append(edit_embedding.likeness(a, b))
    assert near[0] == 1.0 and 1 > near[1] > 0.8 and max(near[2:]) < 0.7
    a, b, c = edit_embedding.fingerprints([text, text[:200] + "!" + text[200:], prose(rng, 800)])
    assert edit_embedding.likeness(a, b) > 0.5 > 0.3 > edit_embedding.likeness(a, c)
    assert edit_embedding.likeness("", "") == 1.0 and edit_embedding.likeness("", a) == 0.0


def plain_walk(text, times=3):
    """A fingerprint step by step, with nothing but the shared tables of random numbers."""
    out, at, n = [], 0, len(text)
    steps = times * n + 64 if n else 0
    octave = 0
    while True:
        low, high = (0, 64) if octave == 0 else (64 << (octave - 1), 64 << octave)
        for _ in range(n and 32):
            out.append("-")
        if high >= steps:
            break
        octave += 1
    places = {low: k for k, low in enumerate(int(j) for o in range(octave + 1) for j in edit_embedding._sampled(o))}
    for j in range(steps):
        c = 0
        if at < n:
            c = (ord(text[at]) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % 255 + 1
        if j in places and c:
            out[places[j]] = "0123456789abcdef"[edit_embedding._DIGIT[c]]
        at += int(edit_embedding._MOVES[j % edit_embedding.PERIOD, c])
    return "".join(out) if at >= n else plain_walk(text, 2 * times)


def walked(text):
    """The characters that the pointer of a walk of three times the text and some more has stood on."""
    at = 0
    for j in range(3 * len(text) + 64):
        if at == len(text):
            break
        c = (ord(text[at]) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % 255 + 1
        at += int(edit_embedding._MOVES[j % edit_embedding.PERIOD, c])
    return at


def test_every_text_is_walked_to_its_end(monkeypatch):
    rng = random.Random(2)
    assert all(walked(text) == len(text) for n in (1, 2, 5, 10, 100, 1000, 5000) for text in (prose(rng, n)[:n] for _ in range(20)))
    # A text that isn't over by then is walked on.
    monkeypatch.setattr(edit_embedding, "SPARE", -200)
    texts = [prose(rng, 60)[:150], prose(rng, 300), "a" * 300]
    longer = edit_embedding.fingerprints(texts)
    monkeypatch.setattr(edit_embedding, "SPARE", 100_000)
    assert all(len(f) > 0 for f in longer) and len(longer[0]) >= 32 * 3


def test_likeness_in_blocks(spark):
    rng = random.Random(9)
    base = prose(rng, 60)
    texts = [base, base + "!", base[:200] + "?" + base[200:], prose(rng, 5), "", prose(rng, 2000), base.replace("w1", "v1")]
    prints = edit_embedding.fingerprints(texts)
    rows = edit_embedding._digits(prints)
    for k, f in enumerate(prints):
        assert edit_embedding.likenesses(rows[k], rows, edit_embedding._weights(rows.shape[1])) == pytest.approx([edit_embedding.likeness(f, g) for g in prints])
    many = [base[:k] + "#" + base[k:] for k in range(0, 300, 3)] * 8
    many = [t + " " * (k // 100) for k, t in enumerate(many)] + [prose(rng, 60) for _ in range(1000)]
    own = {edit_embedding.print_hash(f): f for f in edit_embedding.fingerprints(many)}
    assert len(own) > 2 * edit_embedding.BLOCK
    table = spark.createDataFrame([*own.items()], "h long, fingerprint string")
    crowd = table.selectExpr("7L as band", "h", "h as of", f"{len(own)}L as n")
    got = {(r.a, r.b) for r in edit_embedding._blocks(crowd, table, 0.8).collect()}
    hashes, digits = list(own), edit_embedding._digits([*own.values()])
    brute = set()
    for k, h in enumerate(hashes):
        near = edit_embedding.likenesses(digits[k], digits, edit_embedding._weights(digits.shape[1])) >= 0.8
        brute |= {(min(h, hashes[j]), max(h, hashes[j])) for j in near.nonzero()[0].tolist() if j != k}
    assert {(min(p), max(p)) for p in got} <= brute and 2 * len(got) < len(brute)
    parts = []
    for links in (got, brute):
        root = {h: h for h in own}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        parts.append({frozenset(h for h in own if find(h) == top) for top in {find(h) for h in own}})
    assert parts[0] == parts[1] and len(parts[0]) > 1000


def test_walk_of_single_texts():
    rng = random.Random(12)
    texts = ["", "a", "ab" * 16, "é😀x" * 40, prose(rng, 30), prose(rng, 700), "a" * 64, "b" * 65]
    assert edit_embedding.fingerprints(texts) == [plain_walk(t) for t in texts]


def near_texts(rng, families=40, size=6):
    """Families of texts with edits of all strengths, on a common head that many share."""
    head = prose(rng, 30)
    out = []
    for k in range(families):
        own = prose(rng, rng.choice([8, 40, 150, 400]))
        text = (head + " " if k % 3 == 0 else "") + own
        out.append(text)
        for _ in range(size - 1):
            some = list(text)
            for _ in range(rng.choice([1, 1, 2, 3, 5])):
                some[rng.randrange(len(some))] = rng.choice(["", "q", "zz"])
            out.append("".join(some))
    return [*out, None, "", "", " ", out[0]]


@pytest.mark.parametrize("small", [50, 3])
def test_classes_find_near_pairs(spark, small):
    """Of the pairs that brute force finds near, nine in ten and more share a class; classes hold chains of such pairs only."""
    texts = near_texts(random.Random(4))
    prints = edit_embedding.fingerprints([t or "" for t in texts])
    table = spark.createDataFrame(sorted({(edit_embedding.print_hash(f), f) for f in prints}), "h long, fingerprint string")
    with Workspace(spark) as ws:
        links = edit_embedding.linked(ws, table, small=small).collect()
    by_hash = {edit_embedding.print_hash(f): f for f in prints}
    assert links and all(edit_embedding.likeness(by_hash[r.a], by_hash[r.b]) >= 0.8 for r in links)
    root = {h: h for h in by_hash}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        a, b = sorted((find(r.a), find(r.b)))
        root[b] = a
    hashes = sorted(by_hash)
    near = [(a, b) for k, a in enumerate(hashes) for b in hashes[:k] if edit_embedding.likeness(by_hash[a], by_hash[b]) >= 0.8]
    assert len(near) > 100 and sum(find(a) == find(b) for a, b in near) >= 0.9 * len(near)
    if small == 50:
        rows = [*rows_of(texts), (None, texts[3], None, None, None), (2, texts[10], None, None, None)]
        smallest = {}
        for r in rows:
            if r[0] is not None:
                h = find(edit_embedding.print_hash(edit_embedding.fingerprints([r[1] or ""])[0]))
                smallest[h] = min(r[0], smallest.get(h, r[0]))
        out = edit_embedding.compare_with_next(with_extra(frame(spark, rows)), classes=True).collect()
        assert len(out) == len(rows) and all(r.class_id == smallest[find(edit_embedding.print_hash(r.fingerprint))] for r in out)
        ends = [h for r in links for h in (r.a, r.b)]
        assert all(r.n_links == ends.count(edit_embedding.print_hash(r.fingerprint)) for r in out)


def test_crowded_bands_are_held_against_one_another(spark):
    """A near pair that agrees in one band only, which many others share, and that parts in its further places."""
    rng, samples = random.Random(3), edit_embedding.SAMPLES
    shared, further = ([samples + int(p) for p in edit_embedding._BANDED[1][0][a:b]] for a, b in ((0, 9), (9, 15)))
    bands = [{o * samples + int(p) for p in own[:8]} for o in (0, 1) for own in edit_embedding._BANDED[o]]
    bands[len(bands) // 2] = set(further)
    changed: set[int] = set()
    while left := [b for b in bands if not b & changed]:
        changed.add(max((p for p in range(2 * samples) if p not in shared), key=lambda p: sum(p in b for b in left)))
    one = rng.choices("0123456789abcdef", k=2 * samples)
    two = ["0123456789abcdef"[(int(x, 16) + 1) % 16] if k in changed else x for k, x in enumerate(one)]
    crowd = [[one[k] if k in shared else x for k, x in enumerate(rng.choices("0123456789abcdef", k=2 * samples))] for _ in range(60)]
    prints = ["".join(f) for f in (one, two, *crowd)]
    hashes = [*map(edit_embedding.print_hash, prints)]
    assert edit_embedding.likeness(*prints[:2]) >= 0.8 and min(hashes) not in hashes[:2]
    table = spark.createDataFrame([*zip(hashes, prints, strict=True)], "h long, fingerprint string")
    with Workspace(spark) as ws:
        assert [set(r) for r in edit_embedding.linked(ws, table).collect()] == [set(hashes[:2])]


def test_bands_tell_by_as_many_characters():
    """Where a text is over at some of a band's places, others stand in: texts that just reach an octave don't crowd it."""
    rng = random.Random(8)
    (f,) = edit_embedding.fingerprints([prose(rng, 40)[:70]])
    for octave in edit_embedding._longest(f):
        for b in range(edit_embedding.BANDS):
            assert len(edit_embedding._places(f, octave, b).replace("-", "")) == edit_embedding.PLACES


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_recall_at_production_bands(spark, folder):
    """Documents whose id 50 divides against all others: nine in ten near pairs and more share a class."""
    out = queries.op10_fingerprints(spark, folder).select("doc_id", "fingerprint", "class_id").collect()
    digits = edit_embedding._digits([r.fingerprint for r in out])
    weights, found, near = edit_embedding._weights(digits.shape[1]), 0, 0
    for k, r in enumerate(out):
        if r.doc_id % 50 == 0 or r.doc_id % 10 == 1:
            for j in (edit_embedding.likenesses(digits[k], digits, weights) >= 0.8).nonzero()[0].tolist():
                if j != k:
                    near, found = near + 1, found + (out[j].class_id == r.class_id)
    assert near > 10 and found >= 0.9 * near


SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    docs = documents(spark, SF)
    model = langid.train(docs)
    identified = [r for r in docs.collect() if (p := model.predict(r.text))[0] != "und" and p[1] >= 0.25]
    # The contract of near-duplicate stages: five words, similarity of 0.8 or more.
    split = {r.doc_id: WORD.findall(r.text.translate(LOW)) for r in identified}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in split.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = [r for r in identified if find(r.doc_id) == r.doc_id]
    assert 100 < len(kept) < len(identified)
    clean = pii.sanitise(spark.createDataFrame(kept, docs.schema))
    plan = {r.doc_id: r for r in mixing.mix(clean).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = []
    for r in mixing.repeat(clean, mixing.mix(clean)).collect():
        ids = library.encode(r.text, add_eos=True)
        expected.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), ids))
    assert {r[0] for r in expected} == {i for i, r in plan.items() if r.taken}
    assert run(corpus_pipeline.run(spark, SF)) == sorted(expected, key=repr)


def test_stages_keep_the_columns_and_survive_odd_rows(spark):
    rows = [*rows_of(corpus(1, 8)), (None, "some words", None, None, None), (3, "again", None, None, 1)]
    docs = frame(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count() > 0
    empty = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == [*range(1, 14)]
