"""Telling terms against a plain version, and a text with very many mentions."""

import math
import re
from collections import defaultdict

from preyscope.llm import pii

from .helpers import frame, rows_of
from .test_rows import PATTERNS, valid

TERM = re.compile(r"[^\W\d_]{3,}")


def spans(text, kind):
    return [(m.start(), m.end(), m.group()) for m in re.finditer(PATTERNS[kind], text) if valid(kind, m.group())]


def blanked(text):
    return re.sub(PATTERNS["email"], lambda m: " " * len(m.group()), text)


def plain_terms(texts):
    """Spans of telling terms of each text, by counting all pairs."""
    together, contexts, holds = defaultdict(set), defaultdict(set), defaultdict(set)
    having = defaultdict(set)
    for k, text in enumerate(texts):
        for t in TERM.findall(text.lower()):
            having[t].add(k)
        mentions = [(s, e, f"{kind}:{v.lower()}", None) for kind in PATTERNS for s, e, v in spans(text, kind)]
        all_ = sorted(mentions + [(m.start(), m.end(), "", m.group().lower()) for m in TERM.finditer(blanked(text))])
        for i, (_, _, entity, _) in enumerate(all_):
            if entity:
                near = tuple(x[3] for x in all_[max(0, i - pii.NEAR) : i + pii.NEAR + 1] if x[3])
                holds[entity].add(k)
                for t in near:
                    together[entity, t].add(k)
                    contexts[entity, t].add(near)
    n, telling = len(texts), defaultdict(dict)
    for (e, t), rows in together.items():
        df_e, c = len(holds[e]), len(rows)
        if len(contexts[e, t]) >= pii.SUPPORT and df_e < n:
            share = min(1.0, math.log(c * n / (max(len(having[t]), c) * df_e)) / math.log(n / df_e))
            if share >= pii.GENERALISE:
                for k in holds[e]:
                    telling[k][t] = max(share, telling[k].get(t, 0))
    return [[(m.start(), m.end()) for m in TERM.finditer(blanked(text)) if m.group().lower() in telling[k]] for k, text in enumerate(texts)]


def texts_with_people():
    filler = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "lambda", "epsilon"]
    out = []
    for k in range(12):
        a, b, c = filler[k % 10], filler[(k * 3 + 1) % 10], filler[(k * 7 + 2) % 10]
        out.append(f"{a} {b} write to Zorbax at z@mail.org {c} now. " + " ".join(filler[(k + j) % 10] for j in range(30)) + f" and Zorbax again, Quirin {k} " + ("call Vexley +49 30 1234567 " + b if k % 3 == 0 else ""))
    out += [f"{a} {b} write to nobody at all now, number {k}, Quirin" for k, (a, b) in enumerate((a, b) for a in filler for b in filler)]
    out += [out[0]] * 3 + ["info@common.net " + a + " " + b + f" unique{'abcdefghij'[k % 10]}" for k, (a, b) in enumerate((a, b) for a in filler for b in filler[:5])]
    return out


def test_terms_against_counting_all_pairs(spark):
    texts = texts_with_people()
    expected = plain_terms(texts)
    out = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("term")] for r in pii.find(frame(spark, rows_of(texts))).collect()}
    assert out == {k: [f"term:{a}:{b}" for a, b in rows] for k, rows in enumerate(expected)}
    assert len(out[0]) >= 2 and sum(map(len, expected)) > 20
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows_of(texts))).collect()}
    for k, text in enumerate(texts):
        left, at = [], 0
        for s, e in expected[k]:
            left.append(text[at:s])
            at = e
        assert re.sub(PATTERNS["email"], "<EMAIL>", "".join([*left, text[at:]])).replace("+49 30 1234567", "<PHONE>") == clean[k].replace("<TERM>", ""), k


def test_very_many_mentions_in_one_text(spark):
    n = 100_000
    text = " ".join(f"user{k % 5000}@mail{k % 7}.org wrote note" for k in range(n))
    out = pii.find(frame(spark, rows_of([text, "none", None]))).collect()
    assert sorted(r.n_email for r in out) == [0, 0, n]
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows_of([text, "none", None]))).collect()}
    assert clean[0].count("<EMAIL>") == n and "@" not in clean[0] and clean[1] == "none" and clean[2] is None
