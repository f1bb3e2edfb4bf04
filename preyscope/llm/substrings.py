"""Duplicate spans of words by relative Lempel-Ziv parsing.

The reference blocks are the runs of windows about one anchor gram (see anchors), indexed by the gram; of blocks that are
equal as a whole the first is the reference, and the others are one factor each. Every other block is parsed greedily
against all earlier blocks of its gram: where the next `window` words stand in one of them, the longest match there is
the factor, word by word, and the parse goes on behind it; where they don't, one word is a literal. The windows that
reach over a factor's end are looked up one by one. Equal windows share their anchor gram, so no earlier occurrence is
in another gram's blocks, and the factors cover exactly the windows that start earlier elsewhere.

Grams that many documents show in many versions (see anchors: hot and crowded) have every window as a block of its own;
a factor then is one window, and windows that follow one another are one span. Whole blocks and these windows are
compared by two 64-bit hashes of their words' hashes, with a chance below n^2 / 2^64 of a false repeat among n of them;
parsed factors are compared word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .anchors import CONTESTED, CROWDED, REPEAT, Shape

#: Words of a window, and of an anchor gram.
WINDOW, GRAM = 20, 8
SEED = 42


def word_hashes(text: str) -> np.ndarray:
    words = text.encode().split()  # bytes: ASCII white space only
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, SEED) for w in words), np.uint64, len(words))


def longest_match(words: list[bytes], at: int, starts: list[tuple[list[bytes], int]], window: int) -> tuple[int, int]:
    """(length, index into starts): the longest run of words from `at` on that stands at one of the (block, place) starts,
    where the first `window` words are known to; the first of equals."""
    best, which = 0, 0
    for k, (block, place) in enumerate(starts):
        n = window
        while at + n < len(words) and place + n < len(block) and words[at + n] == block[place + n]:
            n += 1
        if n > best:
            best, which = n, k
    return best, which


class Reference:
    """The earlier blocks of one gram, and their windows by their words."""

    def __init__(self, window: int) -> None:
        self.window, self.blocks = window, []
        self.at: dict[bytes, list[tuple[int, int]]] = {}

    def parse(self, did: int, start: int, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """The factors (start, words, document and start of the match) of the next block, which is then added."""
        w, found, p, end = self.window, [], 0, 0
        windows = [b" ".join(words[k : k + w]) for k in range(len(words) - w + 1)]
        while p < len(windows):
            if (hits := self.at.get(windows[p])) is not None:
                if p < end:  # reaches over the end of the last factor
                    n, which = w, 0
                else:
                    n, which = longest_match(words, p, [(self.blocks[b][2], q) for b, q in hits], w)
                b, q = hits[which]
                found.append((start + p, n, self.blocks[b][0], self.blocks[b][1] + q))
                if p >= end:
                    end = p + n
                    p = end - w
            p += 1
        for q, key in enumerate(windows):
            self.at.setdefault(key, []).append((len(self.blocks), q))
        self.blocks.append((did, start, words))
        return found


def _blocks(rows: DataFrame, contested: DataFrame, window: int) -> DataFrame:
    """Contested blocks with their words joined by blanks: (key, did, s, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for did, first, text, own in anchors.opened(batch):
                words = text.encode().split()
                parts = [b" ".join(words[a : a + n - 1 + window]) for a, n in zip(own["s"].tolist(), own["c"].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own["key"]), pa.array(np.full(len(parts), did)), pa.array(own["s"] + first), pa.array(parts, pa.binary())], [*"abcd"])

    joined = rows.join(anchors.by_document(contested.select("did", "s", "c", "key")), "did")
    return joined.select("did", "base", "text", "spans").mapInArrow(run, "key long, did long, s long, words binary")


def factors(blocks: DataFrame, window: int = WINDOW) -> DataFrame:
    """blocks(key, did, s, words) -> (did, s, n, ref_did, ref_s): the greedy factors of every block against the earlier
    ones of its key, and the windows over their ends. A task holds the blocks of one key, MOST_VERSIONS at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reference = None, Reference(window)
        for batch in batches:
            out: list[tuple[int, ...]] = []
            for k, did, s, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    key, reference = k, Reference(window)
                out += [(did, *f) for f in reference.parse(did, s, words.split(b" "))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], [*"abcde"])

    return blocks.repartition("key").sortWithinPartitions("key", "did", "s").mapInArrow(run, "did long, s long, n long, ref_did long, ref_s long")


def duplicate_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """numbered rows -> (did, s, c): c windows from s on start earlier elsewhere."""
    shape = Shape(window, gram)
    found = anchors.repeats(rows, word_hashes, shape)
    alone = anchors.windows_alone(rows, found.where(f"kind = {CROWDED}"), word_hashes, shape)
    parsed = factors(_blocks(rows, found.where(f"kind = {CONTESTED}"), window), window)
    both = found.where(f"kind = {REPEAT}").unionByName(anchors.first_wins(alone, window))
    return both.select("did", "s", "c").unionByName(parsed.select("did", "s", (F.col("n") - window + 1).alias("c")))


def remove_duplicates(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs(doc_id, text); with `kept`, the text, if asked for.

    A word is removed if a window of `window` words that covers it also starts earlier: in a document with a smaller
    doc_id, or before in the same one. Windows are judged on the input. A null doc_id is the smallest; rows that
    repeat a doc_id count as later documents, in order of text. Null and empty texts have no words.
    """
    rows = anchors.numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, text, spans = (batch.column(k) for k in (1, 2, 3))
            n, gone, digest, kept = [], [], [], []
            for k in range(len(batch)):
                words = text[k].as_py().encode().split()
                left = words
                if spans[k].is_valid:
                    mask = covered(spans[k].values, base[k].as_py(), len(words), window)
                    left = [w for w, x in zip(words, mask.tolist(), strict=True) if not x]
                joined = b" ".join(left)
                n.append(len(words))
                gone.append(len(words) - len(left))
                digest.append(hashlib.sha256(joined).hexdigest())
                kept += [joined.decode()] * texts
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * texts, [*"abcde"[: 4 + texts]])

    spans = anchors.by_document(duplicate_spans(rows, window, gram))
    out = rows.join(spans, "did", "left").select("did", "base", "text", "spans")
    out = out.mapInArrow(run, "did long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
    return anchors.doc_id_of(out, docs)


def covered(spans: pa.StructArray, base: int, n: int, window: int) -> np.ndarray:
    """Which of n tokens the row's spans cover."""
    s, c = spans.field("s").to_numpy() - base, spans.field("c").to_numpy()
    mine = (s >= 0) & (s < 1 << anchors.START_BITS)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, s[mine], 1)
    np.add.at(edge, s[mine] + c[mine] - 1 + window, -1)
    return np.cumsum(edge)[:n] > 0
