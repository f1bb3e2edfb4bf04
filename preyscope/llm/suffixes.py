"""Duplicate spans of bytes by column-wise construction of collection Burrows-Wheeler transforms.

Texts are cut into segments about content-defined anchors (see anchors): equal segments repeat each other as a whole,
and the contested ones, which share their anchor gram but not all bytes, make up collections of bounded size. For a
collection, the parts right of the grams are sorted as end markers, and the parts left of them are inserted column by
column: each round takes one symbol of every segment, places the suffixes it begins by the last-to-first mapping of
the transform so far, and updates transform and longest common prefixes, in sequential arrays. Suffixes that agree in
`window` bytes then are neighbours, and all but the earliest are repeats. A round handles all segments of a collection
at once, and a segment has at most window - gram rounds, so the work is linear in the segments.

The construction over whole texts would need as many rounds over one sequential file as the longest text has bytes; the
anchors cut this to rounds of bounded number over collections that tasks hold in memory in place of files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors
from .anchors import CONTESTED, CROWDED, REPEAT, Shape
from .substrings import covered

#: Bytes of a window, and of an anchor gram.
WINDOW, GRAM = 100, 37
#: Segments of a collection, but for the last key's.
COLLECTION = 4096
#: Ends a left part; UTF-8 has no such byte.
END = 0xFF

_CODES = np.random.default_rng(7).integers(0, 2**63, 256, np.int64).astype(np.uint64)


def byte_hashes(text: str) -> np.ndarray:
    return _CODES[np.frombuffer(text.encode(), np.uint8)]


def _minima(lcp: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(lcp[low : high + 1]) of each range, by minima of power-of-two stretches."""
    table, power = [lcp], 1
    longest = int((high - low).max(initial=0)) + 1
    while power * 2 <= longest:
        last = table[-1]
        table.append(np.minimum(last[:-power], last[power:]))
        power *= 2
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in table])])
    flat = np.concatenate(table)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    at = offsets[level]
    return np.minimum(flat[at + low], flat[at + high + 1 - (1 << level)])


def repeated_windows(key: np.ndarray, left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, row: np.ndarray, anchor: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of the windows of a collection that start earlier in it.

    Segments have a key that stands for their gram, the bytes left of it (left[:, 0] next to it) and right of it,
    padded with zeros, and begin at anchor - n_left of `row`.
    """
    m = len(key)
    whole = np.concatenate([key.astype(">u4").view(np.uint8).reshape(m, 4), right], 1)
    order = np.lexsort((n_right, np.ascontiguousarray(whole).view(f"S{whole.shape[1]}").ravel()))
    # End markers, sorted by key and right part; prefixes count the gram.
    sid, off = order.astype(np.int32), np.zeros(m, np.int32)
    k, r, n = key[order], right[order], n_right[order]
    lcp = np.zeros(m, np.uint8)
    differ = np.concatenate([r[1:] != r[:-1], np.ones((m - 1, 1), bool)], 1).argmax(1)
    lcp[1:] = np.where(k[1:] == k[:-1], gram + np.minimum(differ, np.minimum(n[1:], n[:-1])), 0)
    left = np.concatenate([left, np.zeros((m, 1), np.uint8)], 1)
    left[np.arange(left.shape[1]) >= n_left[:, None]] = END
    bwt = left[sid, 0]
    while True:
        # The last-to-first mapping: symbol occurrences in order of symbol, then of place, are the next rows.
        by_symbol = np.argsort(bwt, kind="stable")
        by_symbol = by_symbol[: int((bwt != END).sum())]
        grown = len(by_symbol) - (len(bwt) - m)
        if not grown:
            break
        symbol = bwt[by_symbol]
        same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
        add = np.zeros(len(by_symbol), np.uint8)
        add[same] = 1 + _minima(lcp, by_symbol[same - 1] + 1, by_symbol[same])
        n_sid, n_off = sid[by_symbol], off[by_symbol] + 1
        sid, off = np.concatenate([sid[:m], n_sid]), np.concatenate([off[:m], n_off])
        lcp, bwt = np.concatenate([lcp[:m], add]), np.concatenate([bwt[:m], left[n_sid, n_off]])
    run = np.cumsum(lcp < window)
    start = anchor[sid] - off
    order = np.lexsort((start, row[sid], run))
    late = np.zeros(len(order), bool)
    late[1:] = run[order][1:] == run[order][:-1]
    again = order[late]
    return row[sid[again]], start[again]


def _pieces(rows: DataFrame, contested: DataFrame, shape: Shape) -> DataFrame:
    """Contested segments with their bytes, by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for did, first, text, own in anchors.opened(batch):
                data, s, c = text.encode(), own["s"], own["c"]
                parts = [data[a:b] for a, b in zip(s.tolist(), (s + c - 1 + shape.length).tolist(), strict=True)]
                columns = [own["key"], np.full(len(s), did), s + first, own["lead"]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(parts, pa.binary())], [*"abcde"])

    joined = rows.join(anchors.by_document(contested.select("did", "s", "c", "lead", "key")), "did")
    return joined.select("did", "base", "text", "spans").mapInArrow(run, "key long, did long, s long, lead long, bytes binary")


def settle_collections(pieces: DataFrame, shape: Shape, size: int = COLLECTION) -> DataFrame:
    """pieces -> (did, s, c): windows that start earlier in a segment of the same key."""
    side = shape.length - shape.gram

    def solve(key: np.ndarray, did: np.ndarray, s: np.ndarray, lead: np.ndarray, parts: list[bytes]) -> pa.RecordBatch:
        n = len(parts)
        lengths = np.fromiter(map(len, parts), np.int64, n)
        flat = np.frombuffer(b"".join(parts), np.uint8)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        who, lead_of = np.repeat(np.arange(n), lengths), np.repeat(lead, lengths)
        left, right = np.zeros((n, side), np.uint8), np.zeros((n, side), np.uint8)
        before, after = place < lead_of, place >= lead_of + shape.gram
        left[who[before], (lead_of - 1 - place)[before]] = flat[before]
        right[who[after], (place - lead_of - shape.gram)[after]] = flat[after]
        local = np.unique(key, return_inverse=True)[1]
        r, a = repeated_windows(local, left, lead, right, lengths - lead - shape.gram, did, s + lead, shape.length, shape.gram)
        r, a, e = anchors.merged(r, a, a + shape.length)
        return pa.RecordBatch.from_arrays([pa.array(r), pa.array(a), pa.array(e - a - shape.length + 1)], ["a", "b", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []

        def taken(upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
            """The first rows held; the others stay."""
            key, did, s, lead = (np.concatenate([h[k] for h in held]) for k in range(4))
            parts = [x for h in held for x in h[4]]
            held[:] = [(key[upto:], did[upto:], s[upto:], lead[upto:], parts[upto:])]
            return key[:upto], did[:upto], s[:upto], lead[:upto], parts[:upto]

        for batch in batches:
            held.append((*(batch.column(k).to_numpy() for k in range(4)), batch.column(4).to_pylist()))
            while sum(len(h[0]) for h in held) >= 2 * size:
                key = np.concatenate([h[0] for h in held])
                ends = np.flatnonzero(key[1:] != key[:-1]) + 1
                if not len(ends):
                    break
                yield solve(*taken(int(ends[min(np.searchsorted(ends, size), len(ends) - 1)])))
        while n := sum(len(h[0]) for h in held):
            key = np.concatenate([h[0] for h in held])
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, n)
            yield solve(*taken(int(ends[min(np.searchsorted(ends, size), len(ends) - 1)])))

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(run, "did long, s long, c long")


def duplicate_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """numbered rows -> (did, s, c): c windows of bytes from s on start earlier elsewhere."""
    shape = Shape(window, gram)
    if 2 * window - gram > 250:
        raise ValueError("segments of at most 250 bytes are built")
    found = anchors.repeats(rows, byte_hashes, shape)
    crowded = anchors.first_wins(anchors.windows_alone(rows, found.where(f"kind = {CROWDED}"), byte_hashes, shape), window)
    settled = settle_collections(_pieces(rows, found.where(f"kind = {CONTESTED}"), shape), shape)
    return found.where(f"kind = {REPEAT}").unionByName(crowded).select("did", "s", "c").unionByName(settled)


def remove_duplicates(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bytes_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs(doc_id, text); `kept` if asked for.

    A byte is removed if a string of `window` bytes that covers it also starts earlier: in a document with a smaller
    doc_id, or before in the same one. Strings are judged on the input and may overlap; a removed run can end within a
    character. A null doc_id is the smallest; rows that repeat a doc_id count as later documents, in order of text.
    Null texts count as empty.
    """
    rows = anchors.numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, text, spans = (batch.column(k) for k in (1, 2, 3))
            n, gone, runs, digest, kept = [], [], [], [], []
            for k in range(len(batch)):
                data = text[k].as_py().encode()
                left, edges = data, 0
                if spans[k].is_valid:
                    mask = covered(spans[k].values, base[k].as_py(), len(data), window)
                    left = np.frombuffer(data, np.uint8)[~mask].tobytes()
                    edges = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
                n.append(len(data))
                gone.append(len(data) - len(left))
                runs.append(edges)
                digest.append(hashlib.sha256(left).hexdigest())
                kept += [left] * bytes_kept
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * bytes_kept, [*"abcdef"[: 5 + bytes_kept]])

    spans = anchors.by_document(duplicate_spans(rows, window, gram))
    out = rows.join(spans, "did", "left").select("did", "base", "text", "spans")
    out = out.mapInArrow(run, "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * bytes_kept)
    return anchors.doc_id_of(out, docs)
