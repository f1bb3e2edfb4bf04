"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Features are hashed character n-grams (one to three letters of lower-cased words) with square-root counts, scaled to
length one. A linear SVM for each family against the others picks the family; each pair of languages of a family has an
SVM of its own, and the language with the most wins (then the largest margins) is predicted. Training collects the
features of a bounded sample of labelled rows, taken from whole texts where they are, and runs on the driver; the weights, a few hundred kB at any input size, go to the
executors with the function, which scores whole texts where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets of n-grams.
BUCKETS = 1 << 12
#: Labelled rows used for training, the bound of the sample: shared among the languages, one of each at least.
TRAIN_ROWS = 3000
EPOCHS, C = 6, 1e-4

# Families of languages by ISO 639-1 code; other languages are families of their own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "sinitic": ("zh", "yue"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "gu", "pa", "ne"),
    "semitic": ("ar", "he", "am", "mt"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def features(text: str) -> np.ndarray | None:
    """Square-root n-gram counts of length one by bucket; None without a letter."""
    if not any(map(str.isalpha, text)):
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    table = _letters(code)
    counts = np.zeros(BUCKETS)
    for at in range(0, len(table), 1 << 20):
        x = table[at : at + (1 << 20) + 2].astype(np.uint64)
        mine = slice(0, min(1 << 20, len(table) - at))
        one, two = x * np.uint64(0x9E3779B97F4A7C15), x[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[1:] * np.uint64(0x165667B19E3779F9)
        three = two[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[2:] * np.uint64(0x85EBCA77C2B2AE63)
        for grams in (one, two, three):
            counts += np.bincount((grams[mine] >> np.uint64(52)).astype(np.int64), minlength=BUCKETS)
    counts = np.sqrt(counts)
    return counts / np.linalg.norm(counts)


def _letters(code: np.ndarray) -> np.ndarray:
    """Code points with one value for everything that is not a letter, runs of it left as they are."""
    low = np.where((code >= 97) & (code <= 122) | (code >= 0xC0) & (code != 0xD7) & (code != 0xF7) & ~((code >= 0x2000) & (code <= 0x206F)), code, 32)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    return low[keep]


@dataclass
class Model:
    families: list[str]
    #: One weight vector a family, the bias last.
    family_weights: np.ndarray
    #: Languages by family, and weights of each pair of them.
    languages: dict[str, list[str]]
    pair_weights: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score from 0 to 1); und, 0 if the text is null or has no letter."""
        x = features(text) if text else None
        if x is None or not self.families:
            return "und", 0.0
        margins = self.family_weights[:, :-1] @ x + self.family_weights[:, -1]
        family = int(margins.argmax())
        rest = np.delete(margins, family)
        sure = 1 / (1 + np.exp(-2 * (margins[family] - rest.max()))) if len(rest) else 1.0
        names = self.languages[self.families[family]]
        if len(names) == 1:
            return names[0], float(sure)
        won = dict.fromkeys(names, 0.0)
        margin: dict[tuple[str, str], float] = {}
        for a, b in combinations(names, 2):
            w = self.pair_weights[a, b]
            m = float(w[:-1] @ x + w[-1])
            margin[a, b], margin[b, a] = m, -m
            won[a if m >= 0 else b] += 1
        total = {a: sum(margin[a, b] for b in names if b != a) for a in names}
        best = max(names, key=lambda a: (won[a], total[a]))
        least = min(margin[best, b] for b in names if b != best)
        return best, float(sure / (1 + np.exp(-2 * least)))


def _svm(x: np.ndarray, y: np.ndarray, seed: int = 5) -> np.ndarray:
    """Weights (bias last) of a linear SVM for y in {-1, 1}: averaged stochastic subgradients, classes weighed alike."""
    n = len(y)
    rng = np.random.default_rng(seed)
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    w, b, mean, mean_b, t, scale = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 0, 1.0
    for epoch in range(EPOCHS):
        for rows in np.array_split(rng.permutation(n), max(1, n // 32)):
            t += 1
            step = 1 / (C * (t + 1 / (C * 4)))
            m = y[rows] * (x[rows] @ w + b)
            g = (weight[rows] * y[rows] * (m < 1)) / len(rows)
            w = w * (1 - step * C) + step * (g @ x[rows])
            b += step * g.sum() * 0.1
            if epoch >= EPOCHS // 2:
                mean += w
                mean_b += b
                scale += 1
    return np.append(mean, mean_b) / max(scale - 1, 1)


def held_out(doc_id: str) -> Column:
    """Rows whose crc32 of doc_id as text leaves 1 on division by 3; null doc_ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from about `rows` rows that are not held out, with as many of each language as there are and fit in.

    Rows are taken by the smallest hashes of doc_id and text, not by place: first the hashes alone, whose share for each
    language follows from its count, then the features of the whole texts below each language's last one. Rows that
    repeat an id and text are one. Only text and lang are learnt from; languages and their counts come from all rows.
    Without any labelled row the model predicts und.
    """
    labelled = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    h = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 40))
    labelled = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), h.alias("h"))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((0, BUCKETS + 1)), {})
    each = max(1, rows // len(counts))

    def below(limits: dict[str, int]) -> DataFrame:
        return labelled.where(F.col("h") <= F.element_at(F.create_map(*[x for lang, limit in limits.items() for x in (F.lit(lang), F.lit(limit))]), F.col("lang")))

    share = {lang: min(1 << 40, int((1 << 40) * (1.3 * each / n + 16 / n))) for lang, n in counts.items()}
    seen: dict[str, list[int]] = {lang: [] for lang in counts}
    for r in below(share).select("lang", "h").distinct().collect():
        seen[r.lang].append(r.h)
    found = below({lang: sorted(own)[:each][-1] for lang, own in seen.items() if own}).dropDuplicates(["lang", "h"]).select("lang", "text", "h")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text, h in zip(*batch.columns, strict=True):
                if (v := features(text.as_py())) is not None:
                    at = np.flatnonzero(v)
                    columns = [pa.array([lang.as_py()]), pa.array([h.as_py()]), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([v[at].astype("<f4").tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, [*"abcd"])

    sample = sorted(found.mapInArrow(gather, "lang string, h long, at binary, v binary").collect(), key=lambda r: (r.lang, r.h))
    x = np.zeros((len(sample), BUCKETS), np.float32)
    for k, r in enumerate(sample):
        x[k, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["v"], "<f4")
    labels = [r.lang for r in sample]
    del sample
    y, langs = np.array(labels), sorted({*labels})
    if not langs:
        return Model([], np.zeros((0, BUCKETS + 1)), {})
    family = np.array([family_of(lang) for lang in y])
    families = sorted(set(family.tolist()))
    one = len(families) == 1
    weights = np.stack([np.zeros(BUCKETS + 1) if one else _svm(x, np.where(family == f, 1, -1)) for f in families])
    model = Model(families, weights, {f: [lang for lang in langs if family_of(lang) == f] for f in families})
    for names in model.languages.values():
        for a, b in combinations(names, 2):
            own = (y == a) | (y == b)
            model.pair_weights[a, b] = _svm(x[own], np.where(y[own] == a, 1, -1))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs(doc_id, text); lang, source and doc_id are no inputs.

    Null texts and texts without a letter are und with score 0; equal texts have equal results, and repeated rows each
    have theirs. Ties go to the first name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = [shared.value.predict(texts[k].as_py()) for k in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["a", "b", "c"])

    key = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"a {key}, b string, c double").toDF("doc_id", "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.25) -> DataFrame:
    """docs without the rows whose language is und or predicted with a score below `least`; no shuffle."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            found = (shared.value.predict(texts[k].as_py()) for k in range(len(batch)))
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
