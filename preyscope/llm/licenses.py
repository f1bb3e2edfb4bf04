"""Licence scan by a positional index of rare tokens.

Templates of licence notices are indexed by word and place. The document frequency of the templates' words is counted
over the whole corpus. A file is looked up by the licence words that it holds itself: of each template whose key
phrases could stand in it, as all their words are there, the LOOKED_UP held words of the highest inverse document
frequency. Every occurrence of such a word votes for (template, place in the file - place in the template). A template is
a candidate where several different words agree on that relative position, and only there its mandatory key phrases are
looked for. Each step is a pass over the words, the votes or the candidates of a row, so work grows with the length of a
text, and nothing but the word counts is shuffled.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let

#: Words as the contract has them, over lower-cased texts.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that count wherever they stand, with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Template:
    label: str
    #: Lower-case words of the notice.
    text: str
    #: Phrases that have to stand in or next to the notice.
    keys: tuple[str, ...]


# Wordings of common licence notices.
TEMPLATES = (
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("lgpl", "licensed under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    Template("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
    Template("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", ("cc by nc nd 4 0",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
    Template("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0 international",)),
    Template("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0 international",)),
    Template("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license as published by the free software foundation either version 3",)),
    Template("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license as published by the free software foundation either version 2",)),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license as published by the free software foundation",)),
    Template("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ("gnu free documentation license",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("you may not use this file except in compliance with the license", "apache org licenses license 2 0")),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products derived from this software",)),
    Template("zlib", "in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose", ("in no event will the authors be held liable",)),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license version 1 0",)),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    Template("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", ("sil open font license",)),
    Template("artistic-2.0", "this is free software and may be distributed under the terms of the artistic license 2 0", ("artistic license 2 0",)),
    Template("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ("changing it is allowed as long as the name is changed",)),
    Template("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    # Paragraphs of the bodies of licences.
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included in all copies or substantial portions",)),
    Template("isc", "provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software", ("the author disclaims all warranties with regard to this software",)),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain the above copyright notice",)),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce the above copyright notice",)),
    Template("apache-2.0", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution 1 definitions", ("terms and conditions for use reproduction and distribution", "january 2004")),
    Template("apache-2.0", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of", ("each contributor hereby grants to you a perpetual worldwide non exclusive",)),
    Template("mpl-2.0", "mozilla public license version 2 0 1 definitions 1 1 contributor means each individual or legal entity that creates contributes to the creation of or owns covered software", ("legal entity that creates contributes to the creation of or owns covered software",)),
    Template("gpl-3.0", "gnu general public license version 3 29 june 2007 copyright 2007 free software foundation inc", ("version 3 29 june 2007",)),
    Template("gpl-2.0", "gnu general public license version 2 june 1991 copyright 1989 1991 free software foundation inc", ("version 2 june 1991",)),
)
#: Words by which a template is looked up at most: the rarest of its words that the file holds.
LOOKED_UP = 8
#: Different words that have to agree on a relative position.
AGREEING = 3
#: Words that a key phrase may stand outside the notice.
NEAR = 2
POSTING = "array<struct<w:string,t:int,p:int>>"


def document_frequency(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[int, dict[str, int]]:
    """(number of documents, documents that hold each template word), over all rows; as many counts as template words."""
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(WORDS), F.lit(0))
    held = docs.select(F.explode_outer(F.array_intersect(words, F.array(*map(F.lit, vocabulary)))).alias("w"))
    counts = {r.w: r.n for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return docs.count(), {w: counts.get(w, 0) for w in vocabulary}


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs(doc_id, text).

    n_base counts the places of all base phrases, first_word and last_word are the first and last start among them
    (null: none). labels has the base labels and those of the verified templates. score is 0 without a label, 0.5 for
    base phrases alone, and above that the share of AGREEING to LOOKED_UP words that agreed on the best template's
    place. Null texts count as empty; repeated rows give repeated rows; other columns are not read; very long texts are
    read whole, in time that grows with their length. Template words are letters and digits.
    """
    total, frequency = document_frequency(docs, templates)
    idf = {w: math.log((1 + total) / (1 + n)) for w, n in frequency.items()}
    vocabulary = sorted({*idf, *(w for p in BASE for w in p.split())})
    text = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))

    def read(w: Column) -> Column:
        return let(F.array_intersect(_literal(vocabulary), w), lambda held: let(_postings(held, idf, templates), lambda looked: found(w, held, looked)))

    def found(w: Column, held: Column, looked: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _bases(w, held).alias("base"), _candidates(w, looked, templates).alias("found"))

    rows = docs.select("doc_id", let(words, read).alias("x")).select("doc_id", "x.*")
    starts, best = F.flatten("base"), F.array_max(F.transform("found", lambda x: x["n"]))
    base_labels = F.filter(F.array(*[F.when(F.size(F.get("base", i)) > 0, F.lit(label)) for i, label in enumerate(BASE.values())]), lambda x: x.isNotNull())
    labels = F.array_union(base_labels, F.transform("found", lambda x: x["label"]))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    score = F.when(best.isNotNull(), 0.5 + 0.5 * F.least(F.lit(1.0), best / LOOKED_UP)).when(F.size(starts) > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), joined(base_labels).alias("base_labels"), joined(labels).alias("labels"), score.alias("score"),
    )


def _literal(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words))


def _hits(w: Column, wanted: Callable[[Column], Column]) -> Column:
    """(w, i) of the words that are wanted, by place."""
    return F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda h: wanted(h["w"]))


def _bases(w: Column, held: Column) -> Column:
    """The starts of each base phrase, ascending; only in files that hold all words of one."""
    none = F.array(*[F.array().cast("array<int>")] * len(BASE))
    some = functools.reduce(Column.__or__, [F.size(F.array_intersect(held, _literal(p.split()))) == len(p.split()) for p in BASE])
    firsts = sorted({p.split()[0] for p in BASE})

    def starts(hits: Column) -> Column:
        return F.array(*[F.transform(F.filter(hits, functools.partial(stand, p.split())), lambda h: h["i"]) for p in BASE])

    def stand(parts: list[str], h: Column) -> Column:
        return functools.reduce(Column.__and__, [h["w"] == parts[0], *[F.coalesce(F.get(w, h["i"] + k) == part, F.lit(False)) for k, part in enumerate(parts[1:], 1)]])

    return F.when(some, let(_hits(w, lambda x: x.isin(firsts)), starts)).otherwise(none)


def _postings(held: Column, idf: dict[str, float], templates: tuple[Template, ...]) -> Column:
    """(w, t, p): words by which this file is looked up, with template and place, of templates whose key words it holds."""

    def posted(t: Column, e: Column) -> Column:
        return F.transform(e["ps"], lambda p: F.struct(e["w"].alias("w"), t.alias("t"), p.alias("p")))

    own = []
    for t, m in enumerate(templates):
        places: dict[str, list[int]] = {}
        for p, v in enumerate(m.text.split()):
            places.setdefault(v, []).append(p)
        need = sorted({v for k in m.keys for v in k.split()})
        # The index as one literal, rarest word first.
        entries = ", ".join(f"named_struct('w', '{v}', 'ps', array({', '.join(map(str, places[v]))}))" for v in sorted(places, key=lambda v: (-idf[v], v)))
        used = F.slice(F.filter(F.expr(f"array({entries})"), lambda e: F.array_contains(held, e["w"])), 1, LOOKED_UP)
        named = F.flatten(F.transform(used, functools.partial(posted, F.lit(t))))
        own.append(F.when(F.size(F.array_intersect(held, _literal(need))) == len(need), named).otherwise(F.array().cast(POSTING)))
    return F.flatten(F.array(*own))


def _candidates(w: Column, looked: Column, templates: tuple[Template, ...]) -> Column:
    """(label, agreeing words) of each verified template and place, for one file's words."""
    lengths = F.array(*[F.lit(len(m.text.split())) for m in templates])
    need = F.array(*[F.array(*[_literal(k.split()) for k in m.keys]) for m in templates])
    names = _literal([m.label for m in templates])
    none = F.array().cast("array<struct<label:string,n:int>>")

    def voted(used: Column) -> Column:
        votes = F.flatten(F.transform(_hits(w, lambda x: F.array_contains(used, x)), lambda h: F.transform(
            F.filter(looked, lambda q: q["w"] == h["w"]), lambda q: F.struct(q["t"].alias("t"), (h["i"] - q["p"]).alias("o"), h["w"].alias("w")))))
        # array_distinct compares each two structs, so equal votes are dropped after sorting.
        distinct = let(F.sort_array(votes), lambda v: F.filter(v, lambda x, k: F.coalesce(x != F.get(v, k - 1), F.lit(True))))
        return let(distinct, agreed)

    def agreed(v: Column) -> Column:
        # Votes are sorted, so equal (template, place) stand together; the AGREEING-th of each run counts it.
        same = lambda k, j: F.coalesce((F.get(v, k)["t"] == F.get(v, j)["t"]) & (F.get(v, k)["o"] == F.get(v, j)["o"]), F.lit(False))
        ends = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda k: same(k, k - (AGREEING - 1)) & ~same(k, k + 1))
        runs = F.transform(ends, lambda k: F.struct(F.get(v, k)["t"].alias("t"), F.get(v, k)["o"].alias("o"), run(v, k).alias("n")))
        good = F.filter(runs, lambda r: F.forall(F.get(need, r["t"]), lambda key: stands_near(key, r["o"], F.get(lengths, r["t"]))))
        return F.when(F.size(v) >= AGREEING, F.transform(good, lambda r: F.struct(F.get(names, r["t"]).alias("label"), r["n"].cast("int").alias("n")))).otherwise(none)

    def stands_near(key: Column, o: Column, length: Column) -> Column:
        here = lambda p: F.coalesce(F.get(w, p) == F.get(key, 0), F.lit(False)) & (F.slice(w, p + 1, F.size(key)) == key)
        return F.exists(F.sequence(o - NEAR, o + length + NEAR), here)

    def run(v: Column, k: Column) -> Column:
        """The length of the run that ends at k, up to LOOKED_UP words."""
        last = F.get(v, k)
        return F.size(F.filter(F.slice(v, F.greatest(F.lit(1), k - LOOKED_UP + 2), F.lit(LOOKED_UP)), lambda x: (x["t"] == last["t"]) & (x["o"] == last["o"])))

    return F.when(F.size(looked) >= AGREEING, let(F.array_distinct(F.transform(looked, lambda q: q["w"])), voted)).otherwise(none)
