import math
import random
import re
import time

from preyscope.llm import licenses, queries

from .helpers import LOW, frame, prose, rows_of


def labels_of(spark, texts):
    return {r.doc_id: {*r.labels.split(",")} - {""} for r in licenses.scan(frame(spark, rows_of(texts))).collect()}


def test_a_file_with_every_notice(spark):
    rng = random.Random(1)
    every = " ".join(t.text + " " + prose(rng, 6) for t in licenses.TEMPLATES)
    long = "hereby software redistribution mozilla domain affero fee copy universal " + prose(rng, 500) + " Licensed under CC BY 4.0. " + prose(rng, 50)
    out = labels_of(spark, [every, long, *[prose(rng, 40) for _ in range(30)]])
    assert out[0] >= {t.label for t in licenses.TEMPLATES}
    assert "cc-by-4.0" in out[1] and "mozilla" not in " ".join(out[1]) and not out[2]


def test_every_file_has_a_notice(spark):
    rng = random.Random(1)
    texts = [prose(rng, 20) + " " + licenses.TEMPLATES[k % len(licenses.TEMPLATES)].text + " " + prose(rng, 20) for k in range(len(licenses.TEMPLATES))]
    out = labels_of(spark, texts)
    assert all(t.label in out[k] for k, t in enumerate(licenses.TEMPLATES))
    same = labels_of(spark, [prose(rng, 20) + " released under the MIT License, " + prose(rng, 20) for _ in range(10)])
    assert all("mit" in x for x in same.values())
    scores = [r.score for r in licenses.scan(frame(spark, rows_of([prose(rng, 9) + " released under the mit license"] * 5))).collect()]
    assert min(scores) > 0.5


def plain_labels(text, idf):
    """Labels by comparing the look-up words of every template, its rarest that the file holds, at every place."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    stands = lambda p, i: words[i : i + len(p)] == p
    found = {label for phrase, label in licenses.BASE.items() if any(stands(phrase.split(), i) for i in range(len(words)))}
    for t in licenses.TEMPLATES:
        own = t.text.split()
        rare = sorted({*own} & {*words}, key=lambda w: (-idf[w], w))[: licenses.LOOKED_UP]
        for at in range(-len(own), len(words)):
            agree = {w for p, w in enumerate(own) if w in rare and 0 <= at + p < len(words) and words[at + p] == w}
            near = range(max(0, at - licenses.NEAR), at + len(own) + licenses.NEAR + 1)
            if len(agree) >= licenses.AGREEING and all(any(stands(k.split(), i) for i in near) for k in t.keys):
                found.add(t.label)
    return ",".join(sorted(found))


def test_labels_of_the_registered_query_and_of_odd_files(spark):
    rng = random.Random(7)
    texts = [t.text for t in licenses.TEMPLATES]
    for t in licenses.TEMPLATES * 2:  # notices with words changed, lost and added
        words = t.text.split(" ")
        for _ in range(rng.choice([1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(["", "other", "the the"])
        texts.append(prose(rng, rng.randrange(9)) + " " + " ".join(words) + " " + rng.choice(licenses.TEMPLATES).text)
    texts += [None, "", texts[3], texts[3], prose(rng, 30_000) + " " + licenses.TEMPLATES[0].text]
    docs = frame(spark, [*rows_of(texts), (None, texts[5], None, None, None)])
    total, frequency = licenses.document_frequency(docs)
    idf = {w: math.log((1 + total) / (1 + n)) for w, n in frequency.items()}
    out = {r.doc_id: r.labels for r in licenses.scan(docs).collect()}
    assert out == {k: plain_labels(t, idf) for k, t in enumerate(texts)} | {None: plain_labels(texts[5], idf)}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    total, frequency = licenses.document_frequency(docs)
    idf = {w: math.log((1 + total) / (1 + n)) for w, n in frequency.items()}
    rows = {r.doc_id: r for r in queries.op2_licenses(spark, "/root/testdata/sf0.001").collect()}
    for d in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (d.text or "").translate(LOW))
        starts = [i for phrase in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        r = rows[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(starts), min(starts, default=None), max(starts, default=None)) and r.labels == plain_labels(d.text, idf)


def test_many_notices_in_one_text_and_notices_without_their_rarest_words(spark):
    many = "released under the mit license and with other words " * 100_000
    began = time.time()
    (r,) = licenses.scan(frame(spark, rows_of([many]))).collect()
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (100_000, 3, 9 * 99_999 + 3, "mit") and time.time() - began < 30
    # A notice keeps its key phrase and loses the rarest of its other words, eight of them.
    rng = random.Random(3)
    template = next(t for t in licenses.TEMPLATES if t.label == "lgpl" and len(t.text.split()) > 20)
    others = [*dict.fromkeys(w for w in template.text.split() if w not in template.keys[0].split())][:8]
    worn = " ".join("worn" if w in others else w for w in template.text.split())
    texts = [prose(rng, 30) + " " + worn + " " + prose(rng, 30), *[" ".join(w for w in template.text.split() if w not in others) for _ in range(4)]]
    docs = frame(spark, rows_of(texts))
    total, frequency = licenses.document_frequency(docs)
    idf = {w: math.log((1 + total) / (1 + n)) for w, n in frequency.items()}
    assert {*sorted(template.text.split(), key=lambda w: -idf[w])[:3]} <= {*others}
    out = {r.doc_id: r.labels for r in licenses.scan(docs).collect()}
    assert out == {k: plain_labels(x, idf) for k, x in enumerate(texts)} and "lgpl" in out[0]
