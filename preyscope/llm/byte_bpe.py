"""Encoding and decoding with byte-level BPE vocabularies.

A text is cut at the vocabulary's added tokens and then into words by its pattern; a word is encoded alone. The words
that an Arrow batch brings anew are merged together, as symbols in one flat numpy array: each round finds the pair of
lowest rank of every word, by binary search of all changed pairs among the sorted pair keys, and carries out all its
merges. A vocabulary is only taken if each of its merges makes a token of its own out of earlier ones; a merge then
leads to pairs of higher rank alone, so that all places of a word's lowest pair can be merged at once, and words of very
many symbols can be merged rank by rank, where a round touches the places of that rank only.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the words of a byte-level pre-tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of more bytes are merged one by one, rank by rank.
LONG = 256
#: Words are merged together up to so many bytes.
FLAT = 1 << 19
#: A Python worker remembers the words met last, in two generations of some so many.
REMEMBERED = 200_000
#: A batch is taken in pieces of about so many characters.
PART = 1_000_000
NONE = np.iinfo(np.int32).max


def alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable bytes themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _leftmost(linked: np.ndarray) -> np.ndarray:
    """Of places in order, of which some follow directly on the one before: every second one of each run, from its first."""
    place = np.arange(len(linked))
    return (place - np.maximum.accumulate(np.where(linked, 0, place))) % 2 == 0


class Vocabulary:
    """Tokens, merges and added tokens of a tokenizer file (JSON)."""

    def __init__(self, data: bytes) -> None:
        import regex

        file = json.loads(data)
        model, before, after = file["model"], file["pre_tokenizer"] or {}, file["decoder"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or file["normalizer"] or file["post_processor"] or {before.get("type"), after.get("type")} != {"ByteLevel"} or before["add_prefix_space"]:
            raise ValueError(f"a plain byte-level BPE vocabulary is needed {odd or ''}")
        if not before.get("use_regex", True):
            raise ValueError("the vocabulary has no pattern of words")
        added = file["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take blanks or whole words only are not supported")
        byte, ids = alphabet(), model["vocab"]
        tokens = {i: bytes(map(byte.__getitem__, t)) for t, i in ids.items()} | {t["id"]: t["content"].encode() for t in added}
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in added}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.token = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.token_size = np.array([*map(len, self.token)], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(self.token), np.uint8)

        self.of_byte = np.full(256, -1, np.int64)
        for c, b in byte.items():
            self.of_byte[b] = ids[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, self.made = (np.array([ids[x] for x in side], np.int64) for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        first = np.full(len(self.token), -1, np.int64)  # the rank of the merge that makes a token
        first[self.made] = np.arange(len(pairs))
        if len({*self.made.tolist()} - {*self.of_byte.tolist()}) < len(pairs) or (np.maximum(first[left], first[right]) >= np.arange(len(pairs))).any():
            raise ValueError("each merge has to make a token of its own out of earlier ones")
        key = left << 32 | right
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int32)

        self.words = regex.compile(WORDS)
        self.newer = self._newer_characters()
        unknown = "".join(map(regex.escape, sorted(self.newer)))
        self.older_words = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{unknown}]]+| ?[\p{{N}}--[{unknown}]]+| ?(?:[^\s\p{{L}}\p{{N}}]|[{unknown}])+|\s+(?!\S)|\s+") if unknown else self.words
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _newer_characters(self) -> set[str]:
        """Characters that are letters or numbers here and to the tokenizers library, built on other tables, are not.

        Only characters that are unassigned to Python, whose tables are older than the library's, can be such.
        """
        import regex
        from tokenizers import pre_tokenizers

        split, named = pre_tokenizers.ByteLevel(add_prefix_space=False), regex.compile(r"[\p{L}\p{N}]")
        some = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c)[0] == "C" and not 0xD800 <= ord(c) < 0xE000 and named.match(c)]
        # A letter or number is no part of a run of exclamation marks.
        return {c for c in some if len(split.pre_tokenize_str("!" + c)) == 1}

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE) if len(self.keys) else np.full(len(a), NONE, np.int32)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """The ids of words that aren't empty, as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        own = np.arange(len(words))  # the words that are left
        word = np.repeat(own, sizes)  # of each symbol, counted among those
        rank = np.full(len(symbols), NONE, np.int32)  # of the pair of a symbol and the next
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self.pair_ranks(symbols[inside], symbols[inside + 1])
        while len(own):
            starts = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat(rank, starts)
            going = low < NONE
            if 8 * sizes[~going].sum() >= len(symbols):
                ended = np.flatnonzero(~going)
                stay = going[word]
                ids = memoryview(symbols[~stay].astype("<u4").tobytes())
                at = 0
                for k, n in zip(own[ended].tolist(), (4 * sizes[ended]).tolist(), strict=True):
                    out[k] = bytes(ids[at : at + n])
                    at += n
                symbols, rank, own, sizes, low = symbols[stay], rank[stay], own[going], sizes[going], low[going]
                word = np.repeat(np.arange(len(own)), sizes)
                if not len(own):
                    break
            at = np.flatnonzero((rank == low[word]) & (rank < NONE))
            linked = np.zeros(len(at), bool)
            linked[1:] = at[1:] == at[:-1] + 1
            if linked.any():
                at = at[_leftmost(linked)]
            symbols[at] = self.made[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            sizes -= np.bincount(word[at], minlength=len(own))
            symbols, word, rank = symbols[stay], word[stay], rank[stay]
            at -= np.arange(len(at))
            rank[at] = NONE
            changed = np.concatenate([at, at[at > 0] - 1])
            changed = changed[changed + 1 < len(symbols)]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed] = self.pair_ranks(symbols[changed], symbols[changed + 1])
        return out

    def merge_long(self, word: bytes) -> bytes:
        """The ids of one word, rank by rank: symbols are linked in arrays, and a round takes all places of one rank."""
        n = len(word)
        symbols = self.of_byte[np.frombuffer(word, np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n)  # before has a place for the end too
        rank = np.full(n + 1, NONE, np.int32)
        agenda: list[tuple[int, int, np.ndarray]] = []
        tie = count()

        def propose(at: np.ndarray) -> None:
            rank[at] = NONE
            at = at[after[at] < n]
            rank[at] = self.pair_ranks(symbols[at], symbols[after[at]])
            at = at[rank[at] < NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1) if len(at) else []:
                heapq.heappush(agenda, (int(rank[part[0]]), next(tie), part))

        propose(np.arange(n))
        while agenda:
            low = agenda[0][0]
            parts = []
            while agenda and agenda[0][0] == low:
                parts.append(heapq.heappop(agenda)[2])
            at = np.unique(np.concatenate(parts))
            at = at[rank[at] == low]
            linked = np.zeros(len(at), bool)
            linked[1:] = after[at[:-1]] == at[1:]
            at = at[_leftmost(linked)]
            gone = after[at]
            symbols[at], rank[gone] = self.made[low], NONE
            after[at] = after[gone]
            before[after[gone]] = at
            propose(np.union1d(at, before[at][before[at] >= 0]))
        left, at = [], 0
        while at < n:
            left.append(at)
            at = int(after[at])
        return symbols[left].astype("<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        coded = sorted(((w, w.encode()) for w in new), key=lambda x: len(x[1]))
        part: list[tuple[str, bytes]] = []
        size = 0

        def merge() -> None:
            if part:
                self.known.update(zip((w for w, _ in part), self.merge_many([b for _, b in part]), strict=True))

        for w, b in coded:
            if len(b) > LONG:
                self.known[w] = self.merge_long(b)
                continue
            if size + len(b) > FLAT:
                merge()
                part, size = [], 0
            part.append((w, b))
            size += len(b)
        merge()

    def split(self, text: str) -> list[str]:
        """The words and the added tokens of a text, in order."""
        if self.split_added and any(t in text for t in self.added):
            return [w for k, x in enumerate(self.split_added.split(text)) for w in ([x] if k % 2 else self.words.findall(x))]
        return self.words.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        split = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        new = {w for words in split for w in words} - self.known.keys() - self.added.keys()
        if newer := not self.newer.isdisjoint("".join(new)):
            # Texts with such characters are cut anew. Words that hold them are not remembered, so they are met here each time.
            plain, self.words = self.words, self.older_words
            split = [words if self.newer.isdisjoint(t) else self.split(t) for t, words in zip(texts, split, strict=True)]
            self.words = plain
            new = {w for words in split for w in words} - self.known.keys() - self.added.keys()
        again = new & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        self.learn([*(new - again)])
        known = self.known
        if newer:
            self.known = {w: x for w, x in known.items() if self.newer.isdisjoint(w)}
        known |= self.added
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """The text of each list of ids, in UTF-8; bytes that are none become U+FFFD."""
        ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int64)
        size = self.token_size[ids]
        ends = np.cumsum(size)
        data = self.token_bytes[np.repeat(self.token_start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        ends, out, at, first = np.concatenate([[0], ends]), [], 0, 0
        for x in coded:
            first, start = first + len(x) // 4, at
            at = int(ends[first])
            try:
                (text := data[start:at]).decode()
            except UnicodeDecodeError:
                text = text.decode("utf-8", "replace").encode()
            out.append(text)
        return out


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(digest: str, data: bytes) -> Vocabulary:
    if digest not in _loaded:
        _loaded[digest] = Vocabulary(data)
    return _loaded[digest]


def encode_decode(docs: DataFrame, path: str, ids_column: str | None = "ids") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 and, if a name
    is given, the ids as an array of ints.

    As the tokenizers library does without special tokens of its own: those written in a text are found, the whole text
    is encoded, decoding keeps them. Null texts count as empty; an empty text has no ids. Very long texts and very long
    words are encoded whole. Repeated rows give repeated rows; an empty table gives none; other columns are not read.
    The tokenizer file (some MB) goes to the executors once; texts stay where they are, so there is no shuffle, and a
    batch is taken in pieces of about PART characters, which keeps a worker's memory small.
    """
    with open(path, "rb") as f:
        data = f.read()
    name = hashlib.sha256(data).hexdigest()
    file = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(name, file.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(batch):
                part, chars, first = [], 0, at
                while at < len(batch) and chars < PART:
                    part.append(texts[at].as_py() or "")
                    chars += len(part[-1])
                    at += 1
                coded = v.encode(part)
                columns = [
                    keys.slice(first, len(coded)),
                    pa.array([len(x) // 4 for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in v.decode(coded)]),
                ]
                if ids_column:
                    ends = np.cumsum([0, *(len(x) // 4 for x in coded)], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")), type=pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [*"abcde"[: len(columns)]])

    key = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"a {key}, b long, c string, d string" + ", e array<int>" * bool(ids_column))
    return out.toDF("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *[ids_column] * bool(ids_column))
