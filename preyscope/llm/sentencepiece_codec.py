"""Encoding and decoding with merge-type SentencePiece vocabularies.

A text becomes blanks-as-markers, cut before each run of markers. No piece of such a vocabulary holds a marker after
another character (checked when the vocabulary is loaded), so no merge crosses a cut and each segment is encoded
alone. Within a segment an agenda of adjacent symbol pairs is worked off by score, leftmost first among equals: long
segments with a heap, short ones many at a time in numpy, where each round carries out the first agenda entry of every
segment. Every new segment of an Arrow batch is then encoded and decoded by the sentencepiece library too; where the
two differ the batch fails.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Segments of at most so many characters are encoded together.
SHORT = 24
#: A Python worker remembers the segments met last, in two generations of some so many.
REMEMBERED = 100_000
#: A batch is taken in pieces of about so many characters.
PART = 1_000_000
NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            value = data[i : i + size]
            i += size
        yield tag >> 3, value


class Vocabulary:
    """The pieces of a model file, the pairs that merge, and the library's own processor."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [dict(_fields(v)) for f, v in _fields(data) if f == 1]
        self.text = [p[1].decode() for p in pieces]
        kind = [p.get(3, NORMAL) for p in pieces]
        score = np.array([np.frombuffer(p.get(2, b"\0" * 4), "<f4")[0] for p in pieces])
        trainer, normalizer = ({f: v for f, v in _fields(next(v for f, v in _fields(data) if f == k))} for k in (2, 3))
        if trainer.get(3) != 2 or normalizer.get(1) != b"identity" or normalizer.get(4, 1) or not normalizer.get(3, 1) or {USER_DEFINED, UNUSED} & {*kind}:
            raise ValueError("a merge-type vocabulary without normalization, user-defined or unused pieces is needed")
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.text, kind, strict=True)) if k == NORMAL}
        if bad := [t for t in self.ids if MARK in t.lstrip(MARK)]:
            raise ValueError(f"pieces that hold a marker after another character: {bad[:3]}")
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, kind, strict=True)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.end, self.unknown = self.library.eos_id(), self.library.unk_id()
        ranks = {s: r for r, s in enumerate(sorted({*score.tolist()}, reverse=True))}
        self.rank = [ranks[float(s)] for s in score.tolist()]
        # Symbols: pieces keep their ids, other characters of pieces get further ones; pairs of symbols lead to pieces.
        self.symbol = dict(self.ids)
        for t in self.ids:
            for c in t:
                self.symbol.setdefault(c, len(self.text) + len(self.symbol))
        self.single = {i: c for c, i in self.symbol.items() if i >= len(self.text)}
        pairs = {(self.symbol[t[:k]], self.symbol[t[k:]]): i for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.symbol and t[k:] in self.symbol}
        self.bits = 20
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.merged = np.zeros(1 << self.bits, np.int32)
        order = sorted(self.ids.values(), key=lambda i: self.rank[i])
        place = {i: r for r, i in enumerate(order)}
        self.by_rank, self.no_rank, self.outside = np.array(order, np.int32), len(order), (1 << 20) - 1
        for (a, b), i in pairs.items():
            key = (a << 20) | b
            at = ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - self.bits)
            while self.slots[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.slots[at], self.merged[at] = key, place[i]
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.lossy: dict[str, str] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that each pair of symbols makes, or no_rank."""
        key = (a.astype(np.int64) << 20) | b
        at = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.slots[at]
        out = np.where(found == key, self.merged[at], self.no_rank)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slots[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.merged[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def _ids(self, symbols: Iterable[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return out

    def encode_long(self, segment: str) -> list[int]:
        """One segment by a heap of (rank, place) over a linked list of symbols."""
        symbols: list[str | None] = list(segment)
        left, right = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        agenda: list[tuple[int, int, int, str]] = []

        def propose(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.ids.get(piece := symbols[a] + symbols[b])) is not None:
                heapq.heappush(agenda, (self.rank[i], a, b, piece))

        for k in range(len(symbols) - 1):
            propose(k, k + 1)
        while agenda:
            _, a, b, piece = heapq.heappop(agenda)
            if symbols[a] is None or symbols[b] is None or right[a] != b or symbols[a] + symbols[b] != piece:
                continue
            symbols[a], symbols[b] = piece, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            propose(left[a], a)
            propose(a, right[a])
        return self._ids(s for s in symbols if s is not None)

    def encode_short(self, segments: list[str]) -> list[list[int]]:
        """Segments of about the same length, with one marker each so that no equal scores meet.

        Each round carries out the best pair of each segment; a segment without a pair is finished.
        """
        n, size = len(segments), np.fromiter(map(len, segments), np.int64, len(segments))
        width = int(size.max()) + 1
        columns = np.arange(width)
        inside = columns < size[:, None]
        grid = np.full((n, width), self.outside, np.int32)
        grid[inside] = np.fromiter(map(self.symbol.__getitem__, "".join(segments)), np.int32)
        done = np.empty_like(grid)
        rank = np.full((n, width), self.no_rank, np.int32)
        pair = inside[:, 1:]
        rank[:, :-1][pair] = self._rank(grid[:, :-1][pair], grid[:, 1:][pair])
        at, later = np.arange(n), np.minimum(columns[None, :] + (columns[None, :] > columns[:, None]), width - 1)
        while True:
            best = rank.argmin(1)
            rows = np.arange(len(best))
            low = rank[rows, best]
            going = low < self.no_rank
            if not going.all():
                done[at[~going]] = grid[~going]
                if not going.any():
                    break
                grid, rank, best, low, at = grid[going], rank[going], best[going], low[going], at[going]
                rows = np.arange(len(best))
            size[at] -= 1
            move = later[best]
            grid[rows, best] = self.by_rank[low]
            grid, rank = np.take_along_axis(grid, move, 1), np.take_along_axis(rank, move, 1)
            before = np.flatnonzero(best)
            rank[before, best[before] - 1] = self._rank(grid[before, best[before] - 1], grid[before, best[before]])
            rank[rows, best] = self._rank(grid[rows, best], grid[rows, best + 1])
        odd = ((done >= len(self.text)) & (columns < size[:, None])).any(1).tolist()
        rows = [row[:k] for row, k in zip(done.tolist(), size.tolist(), strict=True)]
        return [[i for x in row for i in ([x] if x < len(self.text) else self._ids([self.single[x]]))] if o else row for row, o in zip(rows, odd, strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, markers as blanks, without the blank that encoding puts first."""
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i is None or i == self.end:
                continue
            out.append(self.text[i])
        return "".join(out).replace(MARK, " ")[1:]

    def learn(self, new: list[str]) -> None:
        """Encodes segments of about the same length, without their first marker, and holds them against the library."""
        marked = [MARK + s.replace(" ", MARK) for s in new]
        easy = {k for k, s in enumerate(marked) if len(s) <= SHORT and MARK not in s[1:]}
        for c in {c for k in easy for c in marked[k]} - self.symbol.keys():
            self.single[len(self.text) + len(self.symbol)] = c
            self.symbol[c] = len(self.text) + len(self.symbol)
        ids: list[list[int]] = [[] if k in easy else self.encode_long(s) for k, s in enumerate(marked)]
        part = sorted(easy)
        for k, row in zip(part, self.encode_short([marked[k] for k in part]) if part else [], strict=True):
            ids[k] = row
        # The library gives "" no symbols, whereas a segment that is a lone marker has one.
        for s, own, theirs in zip(new, ids, self.library.encode(new, num_threads=1), strict=True):
            if s and own != theirs:
                raise AssertionError(f"the library encodes {s!r} as {theirs}, not {own}")
        for s, own, theirs in zip(new, ids, self.library.decode(ids, num_threads=1), strict=True):
            if (text := self.decode(own)) != theirs:
                raise AssertionError(f"the library decodes {own} as {theirs!r}, not {text!r}")
            if text != s:
                self.lossy[s] = text
        self.known.update(zip(new, (" ".join(map(str, x)) for x in ids), strict=True))

    def segments(self, text: str) -> list[str]:
        """The segments of a text, each without its first marker and with blanks for other markers."""
        if MARK not in text and "  " not in text and text[:1] != " ":
            return text.split(" ") if text else []
        return [s[1:].replace(MARK, " ") for s in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]

    def digest(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids as decimals joined by blanks, with the end id; decoded text) of each text."""
        split = [self.segments(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
            self.lossy = {s: t for s, t in self.lossy.items() if s in self.older}
        new = {s for x in split for s in x} - self.known.keys()
        again = new & self.older.keys()
        self.known.update((s, self.older[s]) for s in again)
        new = sorted(new - again, key=len)
        for at in range(0, len(new), 8192):
            self.learn(new[at : at + 8192])
        known, lossy = self.known, self.lossy
        for segments in split:
            ids = " ".join([known[s] for s in segments] + [str(self.end)])
            yield ids, " ".join([lossy.get(s, s) for s in segments] if lossy else segments)


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(digest: str, data: bytes) -> Vocabulary:
    if digest not in _loaded:
        _loaded[digest] = Vocabulary(data)
    return _loaded[digest]


def encode_decode(docs: DataFrame, model_path: str, ids_column: str | None = "ids") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if a name is given, the ids as an array.

    Null texts count as empty; an empty text has the end id alone. Repeated rows give repeated rows; other columns are
    not read. The model file (a few hundred kB) goes to the executors with the function; texts stay where they are, so
    there is no shuffle, and a batch is taken in pieces of about PART characters; both bounds keep a worker's memory small.
    """
    with open(model_path, "rb") as f:
        data = f.read()
    name = hashlib.sha256(data).hexdigest()
    model = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(name, model.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(batch):
                part, chars, first = [], 0, at
                while at < len(batch) and chars < PART:
                    part.append(texts[at].as_py() or "")
                    chars += len(part[-1])
                    at += 1
                rows = list(v.digest(part))
                columns = [
                    keys.slice(first, len(rows)),
                    pa.array([i.count(" ") + 1 for i, _ in rows], pa.int64()),
                    pa.array([hashlib.sha256(i.encode()).hexdigest() for i, _ in rows]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in rows]),
                ]
                if ids_column:
                    ids = [np.fromstring(i, np.int32, sep=" ") for i, _ in rows]
                    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)), type=pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [*"abcde"[: len(columns)]])

    key = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"a {key}, b long, c string, d string" + ", e array<int>" * bool(ids_column))
    return out.toDF("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *[ids_column] * bool(ids_column))
