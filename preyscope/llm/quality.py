"""Quality rules as a short-circuit cascade.

The measures that are always reported decide the base verdict; what passes goes through rules of the cascade's own, each
a predicate over the text. On a bounded sample each rule's rejection rate is counted and its cost timed, less the time of
an empty pass over the same rows; the cascade then tries rules by rejection per cost, and a row that one rule rejects is
not shown to the later ones: a rule's measure stands inside its branch of a CASE expression and nowhere else. The order
changes the work, never a verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, cut, let

#: At most about so many rows are sampled for cost and selectivity.
SAMPLE_ROWS = 2000
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    #: From the text and the reported measures by name to the condition on which a document is rejected.
    rejects: Callable[[Column, Mapping[str, Column]], Column]


def base_failed(m: Mapping[str, Column]) -> Column:
    """The contract's verdict on the reported measures."""
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def _few_letters(text: Column, m: Mapping[str, Column]) -> Column:
    """Under seven tenths of the characters in words are letters or their marks."""
    return 10 * F.char_length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", "")) < 7 * m["word_chars"]


def _same_pairs(text: Column, m: Mapping[str, Column]) -> Column:
    """Under three tenths of the pairs of neighbouring words are different."""

    def pairs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: (F.size(w) > 1) & (10 * F.size(F.array_distinct(pairs(w))) < 3 * (F.size(w) - 1)))


def _short_lines(text: Column, m: Mapping[str, Column]) -> Column:
    """Of five lines or more, over eight tenths have under three words."""
    return let(_lines(text), lambda x: (F.size(x) >= 5) & (10 * F.size(F.filter(x, lambda y: F.regexp_count(y, F.lit(WORD)) < 3)) > 8 * F.size(x)))


#: Thresholds lie well outside of what documents labelled good show.
RULES = (
    Rule("symbols", lambda t, m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule("word_length", lambda t, m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    Rule("repeated_lines", lambda t, m: 2 * m["n_dup_lines"] > F.size(_lines(t))),
    Rule("few_letters", _few_letters),
    Rule("same_pairs", _same_pairs),
    Rule("short_lines", _short_lines),
)


def _repeat_words(text: Column) -> Column:
    """Words covered by 3-word windows that are found twice or more in the text.

    Windows are hashed and sorted with their places, so equal ones are neighbours; covered words then are the distinct
    places of those windows and of the two that follow.
    """

    def covered(words: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
        return let(F.sort_array(windows), lambda s: F.size(F.array_distinct(F.flatten(places(s)))))

    def places(s: Column) -> Column:
        h = lambda k: F.get(s, k)["h"]
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(h(k) == h(k - 1), F.lit(False)) | F.coalesce(h(k) == h(k + 1), F.lit(False)))
        return F.transform(twice, lambda k: let(F.get(s, k)["i"], lambda i: F.array(i, i + 1, i + 2)))

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(covered(w)))


def measures(text: Column) -> dict[str, Column]:
    """The reported measures of a text that is not null."""
    return {
        "n_words": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "word_chars": F.char_length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(text).cast("long"),
    }


def rank_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, seed: int = 3) -> list[tuple[Rule, float, float]]:
    """(rule, rejection rate, seconds) on a sample of about `rows` rows, by rejection per cost, best first.

    Rates count among the rows that the base verdict lets pass, which are the ones that the rules get to see. Every
    pass runs twice, and the second time counts, so that a rule does not pay for its compilation.
    """
    total = docs.count()
    sample = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).sample(min(1.0, rows / max(total, 1)), seed=seed)
    sample = sample.withColumns(measures(F.col("text")))
    have = {c: F.col(c) for c in sample.columns[1:]}
    sample = cut(sample.where(~base_failed(have)))

    def timed(test: Column) -> tuple[float, float]:
        for _ in range(2):
            began = time.perf_counter()
            n, bad = sample.agg(F.count(F.lit(1)), F.count_if(test)).first()
            seconds = time.perf_counter() - began
        return bad / max(n, 1), seconds

    empty = timed(F.length("text") < 0)[1]
    found = [(rule, *timed(rule.rejects(F.col("text"), have))) for rule in rules]
    return sorted(((rule, bad, max(s - empty, 1e-3)) for rule, bad, s in found), key=lambda x: -x[1] / x[2])


def cascade(docs: DataFrame, order: list[Rule]) -> DataFrame:
    """docs with the reported measures, base_failed and `rejected_by`: null for rows that are kept, else `base` or the
    first rule of `order` that rejects.

    Null texts count as empty. A rule is only evaluated for rows that the base verdict and all earlier rules let pass.
    Rows that repeat an id are judged each by itself; columns of docs with the names of new ones are replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    have = measures(text)
    rows = docs.withColumns(have)
    read = {c: F.col(c) for c in have}
    verdict = F.lit(None).cast("string")
    for rule in reversed(order):
        verdict = F.when(rule.rejects(text, read), F.lit(rule.name)).otherwise(verdict)
    return rows.withColumn("base_failed", base_failed(read)).withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(verdict))
