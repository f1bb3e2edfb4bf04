"""Row-wise operators against brute force: licences, personal data, quality, language ID, tokenizer."""

import random
import re
import unicodedata
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from preyscope.llm import langid, licenses, pii, quality, sentencepiece_codec

from .helpers import LOW, WORD, corpus, frame, prose, rows_of, run, sha, with_extra

MODEL = public_tokenizers.path("piece_bpe_32k.model")

NOTICES = [
    "Released under the MIT License.", "x mit-license MIT\nLICENSE cc.by", "This work is licensed under the GNU General Public License, version 3.",
    "gnu general public", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0. apache license", "émit license mit licenseé",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Kit license", "cc", "license " * 300,
]


def test_licenses(spark):
    texts = [*NOTICES, *corpus(1, 10)]
    out = {r.doc_id: r for r in licenses.scan(with_extra(frame(spark, rows_of(texts)))).collect()}
    for k, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        starts, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            starts += hits
            labels |= {label} if hits else set()
        r = out[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= {*r.labels.split(",")} and 0 <= r.score <= 1 and bool(r.labels) == (r.score > 0)
    assert out[2].labels == "gpl,gpl-3.0" and out[4].labels == "cc-by,cc-by-nc-4.0" and out[7].labels == "mit" and out[5].labels == "apache,apache-2.0"
    assert licenses.scan(frame(spark, [])).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        luhn = sum(int(c) if j % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for j, c in enumerate(digits[::-1]))
        return 16 <= len(digits) <= 19 and luhn % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


PERSONAL = [
    "a@b.c_d@e.f x@y a@b..c a.b+c@d-e.f.g.", "1.2.3.4.5.6.7.8 1.2.3.256 001.002.003.004 1.2.3 9" + "9" * 40 + ".1.1.1", "4111 1111-1111 1111 4111111111111112 4111111111111111111111",
    "+1 (269) 555-3296 4524132264652876 +1 2 +123456789012345678 ++4 55 66 77 88(", "é😀 a@b.cd 😀 +49 30 1234567", "a.b" * 3000, "1 2 " * 3000, "a.a@" * 500, "@", "+1",
]


def test_personal_data(spark):
    texts = [*PERSONAL, *corpus(1, 5)]
    out = {r.doc_id: r for r in pii.find(with_extra(frame(spark, rows_of(texts)))).collect()}
    for k, text in enumerate(texts):
        spans, counts = [], []
        for kind, pattern in PATTERNS.items():
            found = [(m.start(), m.end()) for m in re.finditer(pattern, text or "") if valid(kind, m.group())]
            counts.append(len(found))
            spans += [f"{kind}:{a}:{b}" for a, b in found]
        r = out[k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == sha(",".join(spans)), text[:80]
        assert r.spans == ",".join(spans)
    assert pii.find(frame(spark, [])).count() == 0


def test_disclosing_terms(spark):
    """A name that only stands next to one address, in different contexts, gives it away; common words do not."""
    filler = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    texts = [f"{filler[k]} {filler[(k * 3 + 1) % 8]} write to Zorbax at z@mail.org {filler[(k + 5) % 8]} now" for k in range(6)]
    texts += [f"{a} {b} write to nobody at all now, number {k}" for k, (a, b) in enumerate((a, b) for a in filler for b in filler)]
    docs = frame(spark, rows_of(texts))
    out = {r.doc_id: r for r in pii.find(docs).collect()}
    assert all(f"term:{texts[k].index('Zorbax')}:{texts[k].index('Zorbax') + 6}" in out[k].spans for k in range(6))
    assert not any("term" in out[k].spans for k in range(6, len(texts)))
    clean = {r.doc_id: r for r in pii.sanitise(with_extra(docs)).collect()}
    assert "Zorbax" not in clean[0].text and "<EMAIL>" in clean[0].text and clean[0].n_chars == len(clean[0].text) and "write to" in clean[0].text
    assert clean[20].text == texts[20] and clean[20].key == "x"


def test_sanitise_overlaps_and_nulls(spark):
    rows = [(1, "4111 1111 1111 1111 +49 (30) 123456 x a@b.cd", None, None, 3), (2, None, None, None, None), (3, "", None, None, 0)]
    out = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert out[2] is None and out[3] == "" and out[1].replace(" ", "") == "<CARD><PHONE>x<EMAIL>"


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len({*lines}), len(covered)


def brute_rules(text):
    """The names of the cascade's rules that reject a text, base rules apart."""
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    n, chars, symbols, dup, covered = brute_quality(text)
    pairs = [*zip(words, words[1:], strict=False)]
    rules = {
        "symbols": 10 * symbols > 3 * n, "word_length": chars < 2 * n or chars > 15 * n, "repeated_lines": 2 * dup > len(lines),
        "few_letters": 10 * sum(unicodedata.category(c)[0] in "LM" for c in text) < 7 * chars, "same_pairs": bool(pairs) and 10 * len({*pairs}) < 3 * len(pairs),
        "short_lines": len(lines) >= 5 and 10 * sum(len(WORD.findall(x)) < 3 for x in lines) > 8 * len(lines),
    }
    return n < 50 or 100 * covered > 50 * n, {k for k, v in rules.items() if v}


def test_quality(spark):
    rng = random.Random(8)
    odd = ["a b c", "a b c d a b c", "x\nx\n\n \nx\ny", "| # $ " * 30, "a a a", "a a a a", "é ü\x0bß\x0cz\x1cq"]
    odd += ["".join(f"{rng.choice('abc')} {rng.randrange(10**6)}\n" for _ in range(80)), " ".join(rng.choice(["ab cd", "cd ab ef", "ef ab"]) + f" q{k}q" for k in range(60)), "\n".join(["same line here and there"] * 9 + [prose(rng, 60)])]
    odd += [" ".join(f"{a}" for a in rng.choices("abcdefghij", k=300)), "supercalifragilistic-word" + " supercalifragilistic-words".join(map(str, range(80))), prose(rng, 60) + " %%% $$$" * 9, prose(rng, 50_000, 3000)]
    texts = [*corpus(2, 10), *odd, odd[7], None]
    docs = with_extra(frame(spark, [*rows_of(texts), (None, "no id", None, None, 5)]))
    ranked = quality.rank_rules(docs)
    assert {r.name for r, _, _ in ranked} == {r.name for r in quality.RULES} and all(a[1] / a[2] >= b[1] / b[2] for a, b in zip(ranked, ranked[1:], strict=False))
    kept, names = [], set()
    for order in ([r for r, _, _ in ranked], [*quality.RULES], [*reversed(quality.RULES)]):
        out = {r.doc_id: r for r in quality.cascade(docs, order).collect()}
        assert out.pop(None).base_failed
        assert {k: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for k, r in out.items()} == {k: brute_quality(t) for k, t in enumerate(texts)}
        for k, text in enumerate(texts):
            failed, rules = brute_rules(text)
            assert out[k].base_failed == failed and out[k].rejected_by == ("base" if failed else next((r.name for r in order if r.name in rules), None)), (k, text and text[:60])
            names |= {out[k].rejected_by}
        kept.append({k for k, r in out.items() if r.rejected_by is None})
    assert kept[0] == kept[1] == kept[2] and kept[0] and names >= {"base", "symbols", "few_letters", "repeated_lines"}
    assert quality.rank_rules(frame(spark, [])) and quality.cascade(frame(spark, []), [*quality.RULES]).count() == 0


def test_rejected_rows_skip_later_rules(spark):
    """A rule that fails when it is evaluated does no harm to rows that are rejected before."""
    fails = quality.Rule("fails", lambda t, m: F.when(t.contains("$$$"), F.raise_error(F.lit("evaluated")).cast("boolean")).otherwise(False))
    rng = random.Random(2)
    docs = frame(spark, rows_of([prose(rng, 60) + " $$$" * 30, prose(rng, 60), "short $$$"]))
    out = {r.doc_id: r.rejected_by for r in quality.cascade(docs, [quality.RULES[0], fails]).collect()}
    assert out == {0: "symbols", 1: None, 2: "base"}
    with pytest.raises(Exception, match="evaluated"):
        quality.cascade(docs, [fails, quality.RULES[0]]).collect()


def test_language_id(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    assert model.languages == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    out = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [(r.doc_id, r.lang) for r in table.itertuples() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert {i for i, _ in held} == {r.doc_id for r in docs.where(langid.held_out("doc_id")).collect()}
    assert sum(out[i].lang_pred == lang for i, lang in held) > 0.98 * len(held) and all(0 <= r.score <= 1 for r in out.values())
    odd = with_extra(frame(spark, rows_of([None, "", "12 34 !", "é" * 3, table.text[0] * 50])))
    found = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [found[k].lang_pred for k in range(3)] == ["und"] * 3 and found[3].lang_pred != "und" and found[4].lang_pred == out[0].lang_pred
    assert {r.doc_id for r in langid.keep_identified(odd, model, 0).collect()} == {3, 4}


def test_language_id_without_labels(spark):
    empty = langid.train(frame(spark, []))
    assert langid.predict(frame(spark, rows_of(["some text"])), empty).first().lang_pred == "und"
    one = langid.train(frame(spark, [(k, "a few words", "en", None, None) for k in range(5)]))
    assert langid.predict(frame(spark, rows_of(["some text"])), one).first().lang_pred == "en"


ODD = ["<s>", "</s> x", "  a", " ", "▁", "a ▁▁ b", "<0x41>", "a" * 3000, " " * 50, "汉字😀​\x00", "a\n\n b\t c", "é" * 40, None, ""]


@pytest.mark.parametrize("texts", [[*ODD, *corpus(1, 10)], []], ids=["odd", "none"])
def test_sentencepiece(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = {r.doc_id: r for r in sentencepiece_codec.encode_decode(with_extra(frame(spark, rows_of(texts))), MODEL).collect()}
    assert len(out) == len(texts)
    for k, text in enumerate(texts):
        ids = library.encode(text or "", add_eos=True)
        assert out[k].ids == ids and out[k].n_tokens == len(ids) and out[k].ids_sha256 == sha(" ".join(map(str, ids))) and out[k].decoded_sha256 == sha(library.decode(ids))


def test_heap_and_batch_agenda_agree():
    with open(MODEL, "rb") as f:
        v = sentencepiece_codec.Vocabulary(f.read())
    parts = sorted({"▁" + w for t in corpus(3, 10) + ODD if t for w in re.split("[ ▁]+", t) if len(w) < 20}, key=len)
    for c in {c for p in parts for c in p} - v.symbol.keys():
        v.single[len(v.text) + len(v.symbol)] = c
        v.symbol[c] = len(v.text) + len(v.symbol)
    assert v.encode_short(parts) == [v.encode_long(p) for p in parts]


def test_language_id_learns_from_whole_texts_and_odd_rows(spark):
    """What tells the languages apart comes late in the text; ids are null or repeated, and there are many languages."""
    rng = random.Random(5)
    words = {"en": "the and with house water green", "de": "und der nicht haus wasser grün", "xx": "kaloma tirevu ponase wumika"}
    same = "12 34 - " * 1000
    rows = [(None if k % 3 == 0 else k // 2, same + " ".join(rng.choice(w.split()) for _ in range(60)), lang, None, None) for lang, w in words.items() for k in range(40)]
    rows += [(k, f"{same} zq{k:03d} " * 3, f"l{k:03d}", None, None) for k in range(300)] + rows[:5]
    docs = frame(spark, rows)
    model = langid.train(docs)
    assert {lang for names in model.languages.values() for lang in names} >= {*words, *[f"l{k:03d}" for k in range(300) if zlib.crc32(str(k).encode()) % 3 != 1]}
    out = langid.predict(docs, model).collect()
    assert len(out) == len(rows)
    model = langid.train(docs.where("length(lang) = 2"))
    assert all(model.predict(same + " ".join(rng.choice(w.split()) for _ in range(60)))[0] == lang for lang, w in words.items())
    again = langid.train(docs.where("length(lang) = 2").repartition(7))
    assert (again.family_weights == model.family_weights).all()
