"""Small document tables and plain-Python versions of the operators."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rows_of(texts, source=lambda k: f"s{k % 3}"):
    return [(k, t, "en", source(k), None if t is None else len(t)) for k, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def with_extra(docs):
    """docs with columns whose names the operators use themselves."""
    for name in ("key", "did", "spans", "h", "rank", "size", "start", "base", "terms", "words", "t"):
        docs = docs.selectExpr("*", f"'x' as {name}")
    return docs


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with exact copies, near copies, shared passages, nulls, empties and one long text."""
    rng = random.Random(seed)
    passage = prose(rng, 70, 10_000)
    texts = [prose(rng, rng.choice([3, 19, 20, 21, 60, 200])) for _ in range(n)]
    for k in range(n):
        if k % 7 == 0:
            texts.append(texts[k])
        if k % 5 == 0:
            words = texts[k].split(" ")
            words[len(words) // 2] = "changed"
            texts.append(" ".join(words))
        if k % 6 == 0:
            texts.append(prose(rng, 30) + " " + passage + "\n" + prose(rng, 10))
    return [*texts, None, "", " \n\t ", prose(rng, 3000), "a " * 400, "Grüße 😀 naïve  x " * 30, "ab" * 900]


def run(df):
    return sorted(map(tuple, df.collect()), key=repr)
