"""Exact repeats of fixed-length windows, found through content-defined anchors.

Of the k-grams of a window of `length` tokens, the one with the smallest hash (the leftmost of equals) is its anchor.
Equal windows have equal anchors at equal places, and neighbouring windows mostly share one; a run of windows about the
same anchor is a segment. Segments are a few hundredths as many as tokens, so they can be shuffled where windows
cannot. Two segments with the same anchor gram and the same tokens repeat each other as a whole; segments with the same
gram but other tokens are *contested*: some of their windows may repeat, and they are settled one finer step later.

Rows that leave the map side are pre-aggregated: of the segments that are equal within a piece of some megabytes only
the first goes on. Grams that a bounded sample of documents shows in several versions are hot: their windows travel as
segments of their own. What is hot changes the route, never a result.

Segments are compared by two 64-bit hashes, so n segments hold a false repeat with a chance below n^2 / 2^64 (and need
equal anchors for it). Starts are numbers below 2^40; rows that repeat a doc_id are numbered and keep the number in the
bits above, which orders them as later documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Tokens that are hashed at once; longer texts come in pieces that overlap.
PIECE = 1 << 20
#: Documents sampled for hot grams, and how many of them have to show different versions of a gram.
SAMPLE_DOCS, HOT_DOCS = 2000, 4
#: Hot grams that are kept at most: the bound of what is sent to every task.
MOST_HOT = 10_000
#: Distinct segments of one gram that are settled together; beyond, windows are settled one by one.
MOST_VERSIONS = 1000
START_BITS = 40
NO_ID = -(1 << 63)

REPEAT, CONTESTED, CROWDED = 1, 2, 3

C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs that depends on the order."""
    x = a * C1
    x ^= b + C3
    x ^= x >> np.uint64(32)
    x *= C2
    x ^= x >> np.uint64(29)
    return x


@dataclass
class Shape:
    """Windows of `length` tokens and anchors of `gram` tokens."""

    length: int
    gram: int

    def __post_init__(self) -> None:
        self.half = 1 << (self.gram.bit_length() - 1)
        self.piece = 1 << (self.length.bit_length() - 1)


@dataclass
class Segments:
    """Segments of a batch: document index, first window start, number of windows, gram and token hashes, tokens before
    the gram."""

    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    seg: np.ndarray
    lead: np.ndarray

    def take(self, rows: np.ndarray) -> Segments:
        return Segments(*(x[rows] for x in vars(self).values()))


class Hashed:
    """Hashes of a concatenation of token arrays; bounds[d] to bounds[d + 1] is piece d."""

    def __init__(self, tokens: np.ndarray, bounds: np.ndarray, shape: Shape) -> None:
        self.bounds, self.shape, self.tokens = bounds, shape, tokens
        n, at, power = len(tokens), tokens, 1
        while True:
            if power == shape.half:
                self.gram_half = at
            if power == shape.piece:
                self.block = at
                break
            at = mix(at[:-power], at[power:]) if len(at) > power else at[:0]
            power *= 2
        self.n = n

    def window(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows that start at these places."""
        return mix(self.block[at], self.block[at + self.shape.length - self.shape.piece])

    def segments(self) -> Segments:
        s, n = self.shape, self.n
        none = np.empty(0, np.int64)
        if n < s.length:
            return Segments(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none)
        shift = s.gram - s.half
        grams = mix(self.gram_half[: n - s.gram + 1], self.gram_half[shift : shift + n - s.gram + 1])
        low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        width, power = s.length - s.gram + 1, 1
        while power * 2 <= width:
            low = np.minimum(low[:-power], low[power:])
            power *= 2
        if width > power:
            low = np.minimum(low[: power - width], low[width - power :])
        anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        lengths = np.diff(self.bounds)
        ok = np.ones(len(anchor), bool)  # windows within one piece
        ends = self.bounds[1:]
        over = np.minimum(lengths, s.length - 1)
        bad = np.repeat(ends - over, over) + _ramp(over)
        ok[bad[bad < len(ok)]] = False
        first = ok.copy()
        first[1:] &= ~(ok[:-1] & (anchor[1:] == anchor[:-1]))
        begin = np.flatnonzero(first)
        last = ok.copy()
        last[:-1] &= first[1:] | ~ok[1:]
        end = np.flatnonzero(last)
        stop = end + s.length
        span = stop - begin - s.piece
        seg = mix(mix(self.block[begin], self.block[stop - s.piece]), mix(self.block[begin + span // 2], span.astype(np.uint64)))
        doc = np.searchsorted(self.bounds, begin, "right") - 1
        return Segments(doc, begin, end - begin + 1, grams[anchor[begin]], seg, anchor[begin] - begin)


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def hashed_pieces(ids: list[int], offsets: list[int], tokens: list[np.ndarray], shape: Shape) -> Iterator[tuple[Hashed, np.ndarray, np.ndarray]]:
    """Hashed pieces of about PIECE tokens; with, by piece part, the row's id and the start its part has in the row."""
    part: list[np.ndarray] = []
    who: list[int] = []
    base: list[int] = []
    total = 0

    def flush() -> tuple[Hashed, np.ndarray, np.ndarray]:
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in part])])
        return Hashed(np.concatenate(part), bounds, shape), np.array(who, np.int64), np.array(base, np.int64)

    for row, offset, x in zip(ids, offsets, tokens, strict=True):
        at = 0
        while at + shape.length <= len(x):
            piece = x[at : at + PIECE]
            part.append(piece)
            who.append(row)
            base.append(offset + at)
            total += len(piece)
            at += max(1, len(piece) - shape.length + 1)
            if total >= PIECE:
                yield flush()
                part, who, base, total = [], [], [], 0
    if part:
        yield flush()


def _first_rows(key: np.ndarray, seg: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (key, seg, row, start), and in it where a new (key, seg) begins."""
    order = np.lexsort((start, row, seg, key))
    k, s = key[order], seg[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    return order, fresh


def merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each row, sorted, with those that touch made one."""
    if not len(row):
        return row, start, stop
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = row[1:] != row[:-1]
    # A running maximum of stops within a row: rows are lifted apart by their index.
    lift = np.cumsum(fresh) - 1
    top, low = int(stop.max()) + 1, int(start.min())
    if (lift[-1] + 1) * (top - low) < (1 << 62):
        reach = np.maximum.accumulate(stop - low + lift * (top - low)) - lift * (top - low) + low
        fresh[1:] |= start[1:] > reach[:-1]
        at = np.flatnonzero(fresh)
        return row[at], start[at], np.maximum.reduceat(stop, at)
    return row, start, stop


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*"abcdefgh"[: len(columns)]])


def emit(key: np.ndarray, seg: np.ndarray, row: np.ndarray, start: np.ndarray, count: np.ndarray, lead: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """ROWS: the first of equal segments with kind 0, the others' spans with kind REPEAT."""
    order, fresh = _first_rows(key, seg, row, start)
    own, late = order[fresh], order[~fresh]
    zero = np.zeros(len(own), np.int8)
    yield _batch(zero, key[own].view(np.int64), seg[own].view(np.int64), row[own], start[own], count[own], lead[own])
    if len(late):
        r, s, e = merged(row[late], start[late], start[late] + count[late] - 1 + length)
        spread = mix(r.astype(np.uint64), s.astype(np.uint64)).view(np.int64)
        yield _batch(np.full(len(r), REPEAT, np.int8), spread, spread, r, s, e - s - length + 1, np.zeros(len(r), np.int64))


#: Segments between two steps: kind, gram, tokens, document, first window, windows, tokens before the gram.
ROWS = "kind byte, key long, seg long, did long, s long, c long, lead long"


def numbered(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> did (NO_ID for null), base (the number of a row that repeats a doc_id, shifted), text."""
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(ids.alias("did"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    again = rows.groupBy("did").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if again.isEmpty():
        return rows.select("did", F.lit(0).cast("long").alias("base"), "text")
    number = F.row_number().over(Window.partitionBy("did").orderBy("text")) - 1
    return rows.select("did", F.shiftleft(number.cast("long"), START_BITS).alias("base"), "text")


def doc_id_of(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows with doc_id in place of did."""
    kind = docs.schema["doc_id"].dataType
    return rows.select(F.when(F.col("did") != NO_ID, F.col("did")).cast(kind).alias("doc_id"), *[c for c in rows.columns if c != "did"])


Tokens = Callable[[str], np.ndarray]


def hot_grams(rows: DataFrame, tokens: Tokens, shape: Shape) -> np.ndarray:
    """Grams that at least HOT_DOCS of about SAMPLE_DOCS documents show, in more than one version."""
    share = min(1.0, SAMPLE_DOCS / max(1, rows.count()))
    few = rows.where(F.pmod(F.xxhash64(F.lit(17), "did"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for k in range(len(batch)):
                for h, _, _ in hashed_pieces([k], [0], [tokens(texts[k].as_py())], shape):
                    s = h.segments()
                    key, at = np.unique(s.key, return_index=True)
                    yield _batch(key.view(np.int64), s.seg[at].view(np.int64))

    found = few.select("did", "text").mapInArrow(run, "key long, seg long").groupBy("key")
    several = found.agg(F.count(F.lit(1)).alias("n"), F.min("seg").alias("a"), F.max("seg").alias("b")).where(f"n >= {HOT_DOCS} and a <> b")
    keys = [r.key for r in several.orderBy(F.desc("n"), "key").limit(MOST_HOT).collect()]
    return np.sort(np.array(keys, np.int64).view(np.uint64))


def repeats(rows: DataFrame, tokens: Tokens, shape: Shape) -> DataFrame:
    """numbered rows -> a written table (kind, did, s, c, lead, key).

    REPEAT: the c windows from s on all start earlier elsewhere. CONTESTED: some of them may, among the segments of
    that key; CROWDED: likewise, where a key has more than MOST_VERSIONS segments.
    """
    hot = rows.sparkSession.sparkContext.broadcast(hot_grams(rows, tokens, shape))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, bases, texts in _slices(batch):
                for h, who, base in hashed_pieces(ids, bases, [tokens(t) for t in texts], shape):
                    s = h.segments()
                    at = np.searchsorted(hot.value, s.key)
                    crowd = (at < len(hot.value)) & (hot.value[np.minimum(at, max(0, len(hot.value) - 1))] == s.key) if len(hot.value) else np.zeros(len(at), bool)
                    if crowd.any():
                        few = s.take(crowd)
                        each = np.repeat(few.start, few.count) + _ramp(few.count)
                        code = h.window(each)
                        one = Segments(np.repeat(few.doc, few.count), each, np.ones(len(each), np.int64), code, mix(code, code), np.zeros(len(each), np.int64))
                        rest = s.take(~crowd)
                        s = Segments(*(np.concatenate([a, b]) for a, b in zip(vars(rest).values(), vars(one).values(), strict=True)))
                    yield from emit(s.key, s.seg, who[s.doc], base[s.doc] + s.start - h.bounds[s.doc], s.count, s.lead, shape.length)

    out = rows.select("did", "base", "text").mapInArrow(cut_up, ROWS)
    return written(first_wins(out, shape.length))


def _slices(batch: pa.RecordBatch, chars: int = 2_000_000) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """(did, base, text) of a batch in slices of about so many characters, so that little is held at once."""
    ids, bases, texts = batch.column(0), batch.column(1), batch.column(2)
    part: tuple[list, list, list] = [], [], []
    total = 0
    for k in range(len(batch)):
        text = texts[k].as_py()
        for own, x in zip(part, (ids[k].as_py(), bases[k].as_py(), text), strict=True):
            own.append(x)
        total += len(text)
        if total >= chars:
            yield part
            part, total = ([], [], []), 0
    if part[0]:
        yield part


def first_wins(found: DataFrame, length: int) -> DataFrame:
    """ROWS -> (kind, did, s, c, lead, key): of equal segments of a key all but the first become REPEAT rows.

    Keys with several different segments give these as CONTESTED or CROWDED. Rows of a key meet in one task, sorted;
    versions of a key are held back up to MOST_VERSIONS.
    """

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # (did, s, c, lead) of the versions of the last key
        state: dict[str, int] = {"key": 0, "seg": 0, "open": 0, "crowded": 0}

        def flush() -> Iterator[pa.RecordBatch]:
            if sum(map(len, held)) > 1 and not state["crowded"]:
                v = np.concatenate(held)
                yield _batch(np.full(len(v), CONTESTED, np.int8), *v.T, np.full(len(v), state["key"], np.int64))
            held.clear()
            state["crowded"] = 0

        for batch in batches:
            kind, key, seg, did, s, c, lead = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            if not len(kind):
                continue
            done = kind == REPEAT
            if done.any():
                yield _batch(kind[done], did[done], s[done], c[done], lead[done], key[done])
                key, seg, did, s, c, lead = (x[~done] for x in (key, seg, did, s, c, lead))
                if not len(key):
                    continue
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (seg[1:] != seg[:-1])
            fresh[0] = not (state["open"] and key[0] == state["key"] and seg[0] == state["seg"])
            if not fresh.all():
                late = ~fresh
                r, a, e = merged(did[late], s[late], s[late] + c[late] - 1 + length)
                yield _batch(np.full(len(r), REPEAT, np.int8), r, a, e - a - length + 1, *np.zeros((2, len(r)), np.int64))
            v = np.stack([did, s, c, lead], 1)[fresh]
            keys = key[fresh]
            if len(keys):
                bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
                sizes = np.diff(bounds)
                # The first key may go on from the last batch, the last may go on in the next; those between are whole.
                starts = 0
                if state["open"] and keys[0] == state["key"]:
                    held.append(v[: sizes[0]])
                    starts = 1
                    yield from crowd(held, state)
                if len(sizes) > starts:
                    if state["open"]:
                        yield from flush()
                    inner = slice(bounds[starts], bounds[-2])
                    several = np.repeat(sizes[starts:-1] > 1, sizes[starts:-1])
                    many = np.repeat(sizes[starts:-1] > MOST_VERSIONS, sizes[starts:-1])
                    if several.any():
                        w = v[inner][several]
                        kinds = np.where(many[several], CROWDED, CONTESTED).astype(np.int8)
                        yield _batch(kinds, *w.T, keys[inner][several])
                    held.append(v[bounds[-2] :])
                    state["key"] = int(keys[-1])
                    yield from crowd(held, state)
            state["open"], state["key"], state["seg"] = 1, int(key[-1]), int(seg[-1])
        yield from flush()

    def crowd(held: list[np.ndarray], state: dict[str, int]) -> Iterator[pa.RecordBatch]:
        if state["crowded"] or sum(map(len, held)) > MOST_VERSIONS:
            v = np.concatenate(held)
            held.clear()
            state["crowded"] = 1
            yield _batch(np.full(len(v), CROWDED, np.int8), *v.T, np.full(len(v), state["key"], np.int64))

    dealt = found.repartition("key").sortWithinPartitions("key", "seg", "did", "s")
    return dealt.mapInArrow(settle, "kind byte, did long, s long, c long, lead long, key long")


def windows_alone(rows: DataFrame, contested: DataFrame, tokens: Tokens, shape: Shape) -> DataFrame:
    """The windows of contested segments as ROWS: each a segment of its own, keyed by its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for did, first, text, own in opened(batch):
                s, c = own["s"], own["c"]
                x = tokens(text)
                h = Hashed(x, np.array([0, len(x)]), shape)
                each = np.repeat(s, c) + _ramp(c)
                code, one = h.window(each), np.ones(len(each), np.int64)
                yield from emit(code, mix(code, code), one * did, each + first, one, 0 * one, shape.length)

    joined = rows.join(by_document(contested.select("did", "s", "c")), "did")
    return joined.select("did", "base", "text", "spans").mapInArrow(run, ROWS)


def opened(batch: pa.RecordBatch) -> Iterator[tuple[int, int, str, dict[str, np.ndarray]]]:
    """(did, base, text, columns of spans with starts in the text) of rows (did, base, text, spans) that have spans."""
    did, base, text, spans = (batch.column(k) for k in range(4))
    for k in range(len(batch)):
        if not spans[k].is_valid:
            continue
        own, first = spans[k].values, base[k].as_py()
        found = {f.name: own.field(f.name).to_numpy() for f in own.type}
        found["s"] = found["s"] - first
        mine = (found["s"] >= 0) & (found["s"] < 1 << START_BITS)
        if mine.any():
            yield did[k].as_py(), first, text[k].as_py(), {c: x[mine] for c, x in found.items()}


def by_document(spans: DataFrame) -> DataFrame:
    """(did, s, c, ...) -> did, spans: what is known about a document, in one row."""
    rest = [c for c in spans.columns if c != "did"]
    return spans.groupBy("did").agg(F.collect_list(F.struct(*rest)).alias("spans"))
