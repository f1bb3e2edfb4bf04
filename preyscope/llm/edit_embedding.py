"""Document fingerprints by randomised edit embedding.

A pointer walks over a text's characters: at step j it writes the character under it and moves on if a random bit of
(j, character) says so. All texts share the bits, so texts that differ by few edits soon walk in step again, and their
edit distance becomes a Hamming distance of what was written. A text of n characters is walked for 3n + 64 steps, which is
far beyond its end: the pointer needs 2n on average; a walk that hasn't ended by then goes on. Of each
octave of steps ([0, 64), [64, 128), [128, 256), ...) the same few places are sampled in all texts and their characters
hashed to four bits; the fingerprint is these as hex digits, "-" where the text was over. Two fingerprints' likeness is
the share of equal samples, octaves weighed by the steps they stand for.

Texts of a batch are walked side by side in numpy, longest first, so a step costs one operation for all that are still
under way. A text has 3n steps, so one of 10^8 characters keeps a task busy for minutes, whatever else there is.

Classes of near documents come from bit-sampled bands: each of the two octaves in which a text has most steps, three
quarters of them or more, has several bands of a few places drawn at random, the same in all texts. Where a text is over
at some of them, as many of the octave before take their place, so a band always tells by PLACES characters. All
fingerprints that agree in a band are candidates, however many, and likeness verifies them (see linked()).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import Workspace
from .common import components, written

#: The first octave, and places sampled of each octave.
FIRST, SAMPLES = 64, 32
#: Steps beyond three times the characters, for short texts.
SPARE = 64
#: Characters that are walked over side by side at most, but for a single longer text.
BATCH_CHARS = 12_000_000
#: Characters by which rows that repeat a doc_id are sorted.
HEAD = 32
#: Random bits repeat after so many steps.
PERIOD = 1 << 13
OCTAVES = 40
#: Bands of an octave, and places of a band.
BANDS, PLACES = 14, 8
#: The likeness from which documents are near.
LEAST = 0.8
NO_ID = -(1 << 63)
#: Fingerprints of a band that a task holds against as many others.
BLOCK = 512

_rng = np.random.default_rng(20)
_MOVES = _rng.integers(0, 2, (PERIOD, 256), np.int64)
_MOVES[:, 0] = 0  # past the end
_DIGIT = _rng.integers(0, 16, 256).astype(np.uint8)
_DIGIT[0] = 16
_PLACES = [np.sort(_rng.choice(min(FIRST << max(0, k - 1), 1 << 20), SAMPLES, replace=False)).astype(np.int64) for k in range(OCTAVES)]
_BANDED = [[_rng.permutation(SAMPLES) for _ in range(BANDS)] for _ in range(OCTAVES)]
_FILLED = [[np.random.default_rng([21, k, b]).permutation(SAMPLES) for b in range(BANDS)] for k in range(OCTAVES)]
_HEX = np.frombuffer(b"0123456789abcdef-", np.uint8)


def _octave(k: int) -> tuple[int, int]:
    """Steps of octave k, end exclusive."""
    return (0, FIRST) if k == 0 else (FIRST << (k - 1), FIRST << k)


def _sampled(k: int) -> np.ndarray:
    """Sampled steps of octave k; octaves of over 2^20 steps are sampled on a grid."""
    low, high = _octave(k)
    return low + _PLACES[k] * max(1, (high - low) >> 20)


def _classes(text: str) -> np.ndarray:
    """Characters as 255 classes from 1 up."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return ((code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def fingerprints(texts: list[str], times: int = 3) -> list[str]:
    """Fingerprints of whole texts; "" for an empty one. A text whose end isn't reached is walked anew for twice as long."""
    parts = [_classes(t) for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    order = np.argsort(-sizes, kind="stable")
    flat = np.concatenate([x for k in order.tolist() for x in (parts[k], np.zeros(1, np.uint8))] or [np.zeros(1, np.uint8)])
    steps = np.where(sizes[order] > 0, times * sizes[order] + SPARE, 0)
    ends = np.cumsum(sizes[order] + 1) - 1
    at = ends - sizes[order]
    longest = int(steps.max(initial=0))
    octaves = next(k for k in range(OCTAVES) if longest <= _octave(k)[1])
    digits = np.full((len(texts), SAMPLES * (octaves + 1)), 16, np.uint8)
    samples = {int(j): k * SAMPLES + n for k in range(octaves + 1) for n, j in enumerate(_sampled(k))}
    going = len(texts)
    for j in range(longest):
        while going and steps[going - 1] <= j:
            going -= 1
        own = at[:going]
        c = flat.take(own)
        if j in samples:
            digits[:going, samples[j]] = _DIGIT.take(c)
        own += _MOVES[j % PERIOD].take(c)
    letters = _HEX[digits].tobytes().decode()
    width, out = digits.shape[1], [""] * len(texts)
    for place, k in enumerate(order.tolist()):
        used = next(n for n in range(octaves + 1) if steps[place] <= _octave(n)[1]) + 1 if steps[place] else 0
        out[k] = letters[place * width : place * width + used * SAMPLES]
    if len(open_ := order[at < ends]):
        for k, f in zip(open_.tolist(), fingerprints([texts[k] for k in open_.tolist()], 2 * times), strict=True):
            out[k] = f
    return out


def likeness(a: str, b: str) -> float:
    """The weighed share of equal samples, 0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    total = same = 0.0
    for k in range(max(len(a), len(b)) // SAMPLES):
        x, y = a[k * SAMPLES : (k + 1) * SAMPLES], b[k * SAMPLES : (k + 1) * SAMPLES]
        if not x or not y:
            n, hits = len((x or y).replace("-", "")), 0
        else:
            n = sum(p != "-" or q != "-" for p, q in zip(x, y, strict=True))
            hits = sum(p == q != "-" for p, q in zip(x, y, strict=True))
        low, high = _octave(k)
        weight = (high - low) / SAMPLES
        total += weight * n
        same += weight * hits
    return same / total if total else 0.0


def edited(text: str, other: str) -> str:
    """text with its last half replaced by as many of the first characters of the other, or by all it has."""
    n = len(text) // 2
    return text[: len(text) - n] + other[:n]


def _splits(docs: DataFrame) -> list[int]:
    """Bounds of ranges of doc_id: quantiles, a few for each shuffle partition."""
    n = max(1, 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sorted({int(x) for x in docs.select(_did().alias("did")).approxQuantile("did", [k / n for k in range(1, n)], 0.1 / n)}) if n > 1 else []


def _did() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _part(bounds: list[int]) -> Column:
    splits = F.array(*[F.lit(x).cast("long") for x in bounds]).cast("array<long>")
    return F.size(F.filter(splits, lambda x: x <= F.col("did")))


def _packed(docs: DataFrame) -> DataFrame:
    """(did, head, text): the text's first characters, by which rows of one id are sorted, and the text compressed: texts
    are all that is shuffled here, and they take half the room so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            columns = [batch.column(0), pa.array([t[:HEAD] for t in texts], pa.string()), pa.array([pack.compress(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*"abc"])

    return docs.select(_did().alias("did"), _text().alias("text")).mapInArrow(run, "did long, head string, text binary")


def _dealt(docs: DataFrame, named: DataFrame, bounds: list[int]) -> DataFrame:
    """(part, last, did, head, text, ...): _packed() documents and what is known of their prints, dealt by ranges of doc_id,
    each range ending with the next one's first row. What is known on the driver is the first id of each range."""
    rows = docs.select(_did().alias("did"))
    part = _part(bounds)
    firsts = {r.part: r.first for r in rows.select(part.alias("part"), "did").groupBy("part").agg(F.min("did").alias("first")).collect()}
    parts = sorted(firsts)
    before = {p: parts[k - 1] for k, p in enumerate(parts)}
    first = F.get(F.array(*[F.lit(firsts.get(p)).cast("long") for p in range(len(bounds) + 1)]), F.col("part"))
    prior = F.get(F.array(*[F.lit(before.get(p)).cast("int") for p in range(len(bounds) + 1)]), F.col("part"))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("last"))
    places = F.when(F.col("did") == first, F.array(own, F.struct(prior.alias("part"), F.lit(True).alias("last")))).otherwise(F.array(own))
    both = _packed(docs).unionByName(named, allowMissingColumns=True).withColumn("part", part)
    return both.select(F.explode(places).alias("p"), *[c for c in both.columns if c != "part"]).select("p.part", "p.last", "did", "head", "text", "t", "fingerprint", "class_id", "n_links")


def print_hash(fingerprint: str | bytes) -> int:
    """A fingerprint's XXH64 as a signed number."""
    return xxhash.xxh64_intdigest(fingerprint) - ((xxhash.xxh64_intdigest(fingerprint) >> 63) << 64)


def text_hash(text: str) -> int:
    return print_hash(text.encode("utf-8", "surrogatepass"))


def compare_with_next(docs: DataFrame, classes: bool = False) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs;
    with class_id and n_links (see class_ids()) if asked for.

    The next document is the one that follows by doc_id (null first), after the last the first; rows that repeat a
    doc_id follow one another in order of their first HEAD characters, then of their compressed form. The edited text has its last half replaced by the start of the next
    document. Null texts count as empty; very long texts are walked whole. Texts are shuffled once, by ranges of doc_id;
    fingerprints, for which each text is walked once, and classes go to the same ranges.
    """
    bounds = _splits(docs)
    prints = written(printed(docs)) if classes else printed(docs)
    named = prints.select("did", "t", "fingerprint").withColumns({c: F.lit(None).cast("long") for c in ("class_id", "n_links")})
    if classes:
        named = named.unionByName(class_ids(prints), allowMissingColumns=True)
    dealt = _dealt(docs, named, bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bool, int, str, str, tuple]] = []
        known: dict[tuple[int, int], str] = {}
        shared: dict[tuple[int, int], tuple] = {}
        chars, unpack = 0, zstandard.ZstdDecompressor()
        for batch in batches:
            columns = [batch.column(k) for k in range(1, 9)]
            for k in range(len(batch)):
                last, did, _, packed, t, f, *own = (c[k].as_py() for c in columns)
                if packed is None:  # nulls come first, so a document's print is known before its text
                    if f is None:
                        shared[did, t] = own
                    else:
                        known[did, t] = f
                    continue
                text = unpack.decompress(packed).decode("utf-8", "surrogatepass")
                key = did, text_hash(text)
                held.append((last, did, text, known[key], shared.get(key, (None if did == NO_ID else did, 0))))
                chars += len(text)
                if chars >= BATCH_CHARS and len(held) > 1:
                    yield pairs(held)
                    held = held[-1:]
                    known, shared = ({key: x for key, x in d.items() if key[0] >= held[0][1]} for d in (known, shared))
                    chars = len(held[0][2])
        if len(held) > 1:
            yield pairs(held)

    def pairs(held: list[tuple[bool, int, str, str, tuple]]) -> pa.RecordBatch:
        """Every row but the last, and but for the end marks, with the row that follows it."""
        own = [k for k in range(len(held) - 1) if not held[k][0]]
        texts, plain = [h[2] for h in held], [h[3] for h in held]
        other = [edited(texts[k], texts[k + 1]) for k in own]
        changed = fingerprints(other)
        columns = [
            pa.array([held[k][1] for k in own], pa.int64()),
            pa.array([len(texts[k]) for k in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in other], pa.string()),
            pa.array([plain[k] for k in own], pa.string()),
            pa.array(changed, pa.string()),
            pa.array([likeness(plain[k], f) for k, f in zip(own, changed, strict=True)], pa.float64()),
            pa.array([likeness(plain[k], plain[k + 1]) for k in own], pa.float64()),
            *[pa.array([held[k][4][n] for k in own], pa.int64()) for n in (0, 1)],
        ]
        return pa.RecordBatch.from_arrays(columns, [*"abcdefghi"])

    dealt = dealt.repartition("part").sortWithinPartitions("part", "last", "did", "head", "text")
    out = dealt.mapInArrow(run, "did long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long, n_links long")
    kind = docs.schema["doc_id"].dataType
    out = out.select(F.when(F.col("did") != NO_ID, F.col("did")).cast(kind).alias("doc_id"), *out.columns[1:])
    return out if classes else out.drop("class_id", "n_links")


def printed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (did, t, h, fingerprint), the hashes of text and fingerprint; texts stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(batch):
                first, part, chars = at, [], 0
                while at < len(batch) and chars < BATCH_CHARS:
                    part.append(texts[at].as_py())
                    chars += len(part[-1])
                    at += 1
                found = fingerprints(part)
                hashes = [pa.array(map(f, x), pa.int64()) for f, x in ((text_hash, part), (print_hash, found))]
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(part)), *hashes, pa.array(found, pa.string())], [*"abcd"])

    return docs.select(_did().alias("did"), _text().alias("text")).mapInArrow(run, "did long, t long, h long, fingerprint string")


def _longest(f: str) -> list[int]:
    """The two octaves of a fingerprint in which its text has most steps, by the samples before its end."""
    steps = [((_octave(k)[1] - _octave(k)[0]) * (SAMPLES - f.count("-", k * SAMPLES, (k + 1) * SAMPLES)), k) for k in range(len(f) // SAMPLES)]
    return [k for n, k in sorted(steps, reverse=True)[:2] if n]


def _places(f: str, octave: int, b: int) -> str:
    """A fingerprint's digits at a band's places; for each that is past the end also one of the octave before, of the
    first octave one of its own."""
    own = f[octave * SAMPLES : (octave + 1) * SAMPLES]
    order = _BANDED[octave][b]
    digits = "".join(own[p] for p in order[:PLACES])
    if none := digits.count("-"):
        before = f[(octave - 1) * SAMPLES : octave * SAMPLES] if octave else ""
        others = "".join([before[p] for p in _FILLED[octave][b]] if octave else [own[p] for p in order[PLACES:]])
        digits += others.replace("-", "")[:none]
    return digits


def _bands(prints: DataFrame) -> DataFrame:
    """prints(h, fingerprint) -> (band, h): the hash of each band's places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for h, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for octave in _longest(f):
                    out += [(print_hash(f"{octave} {b} {_places(f, octave, b)}"), h) for b in range(BANDS)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 2)], [*"ab"])

    return prints.select("h", "fingerprint").mapInArrow(run, "band long, h long")


def _led(bands: DataFrame) -> DataFrame:
    """bands(band, h) -> (band, h, leader): the members of bands that have several, with the smallest; one shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader: tuple[int, int] | None = None
        alone = False
        for batch in batches:
            if not len(batch):
                continue
            band, h = (batch.column(k).to_numpy() for k in range(2))
            fresh = np.ones(len(band), bool)
            fresh[1:] = band[1:] != band[:-1]
            goes_on = leader is not None and leader[0] == band[0]
            fresh[0] = not goes_on
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(band)), 0))
            led = np.where((first == 0) & goes_on, leader[1] if goes_on else 0, h[first])
            several = ~fresh
            several[:-1] |= ~fresh[1:] & fresh[:-1]
            rows = [band[several], h[several], led[several]]
            if goes_on and alone:  # the leader itself, now that there is another
                rows = [np.append(r, x) for r, x in zip(rows, (leader[0], leader[1], leader[1]), strict=True)]
            alone = bool(fresh[-1])
            leader = int(band[-1]), int(led[-1])
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], [*"abc"])

    return bands.repartition("band").sortWithinPartitions("band", "h").mapInArrow(run, "band long, h long, leader long")


def _verified(ws: Workspace, pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """pairs(a, b) of fingerprint hashes whose likeness is at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array([likeness(a, b) >= least for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], [*"ab"])

    # Merged at every size: the prints' shuffle, which is reused, is the same share of a small input as of a large one.
    one, two = (prints.select(F.col("h").alias(c), F.col("fingerprint").alias(f)).hint("merge") for c, f in (("a", "x"), ("b", "y")))
    return ws.keep(pairs.distinct().join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _digits(prints: list[str]) -> np.ndarray:
    """Fingerprints as rows of bytes, as wide as the longest."""
    width = max(map(len, prints), default=0)
    return np.frombuffer("".join(f.ljust(width, "-") for f in prints).encode(), np.uint8).reshape(len(prints), width)


def _weights(width: int) -> np.ndarray:
    return np.repeat([float(_octave(k)[1] - _octave(k)[0]) for k in range(width // SAMPLES)], SAMPLES)


def likenesses(one: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """likeness() of one fingerprint with each row of _digits()."""
    none = ord("-")
    same = ((rows == one) & (one != none)) @ weights
    total = ((rows != none) | (one != none)) @ weights
    return np.where(total > 0, same / np.where(total > 0, total, 1), 1.0)


def _blocks(open_: DataFrame, prints: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b): verified links that join all near parts within the bands of open_(band, h, of, n), for bands of any size.

    A band's fingerprints are dealt to blocks of about `block` and each two blocks meet in a task, which gives out only links
    that join parts which its earlier ones haven't joined: fewer than it has fingerprints.
    """
    blocks = F.floor(F.col("n") / block) + 1
    own = F.pmod(F.xxhash64("h", F.lit(1)), blocks)
    dealt = open_.join(prints.select("h", "fingerprint").hint("merge"), "h").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "h", "of", "fingerprint")

    def links(group: list[tuple]) -> Iterator[tuple[int, int]]:
        low, high = group[0][1:3]
        left, right = [x for x in group if x[3] == low], [x for x in group if x[3] == high]
        rows = _digits([x[6] for x in left + right])
        weights, right_h = _weights(rows.shape[1]), np.array([x[4] for x in right])
        of, total = np.array([x[5] for x in left + right]), (rows != ord("-")) @ weights
        for k, x in enumerate(left):
            # No pair is more alike than the shares of steps that its texts have.
            sizes = np.minimum(total[len(left) :], total[k]) + 1e-6 >= least * np.maximum(total[len(left) :], total[k])
            good = np.flatnonzero(sizes & (of[len(left) :] != of[k]) & (right_h > x[4] if low == high else True))
            if not len(good):
                continue
            near = good[likenesses(rows[k], rows[len(left) :][good], weights) >= least]
            met, first = np.unique(of[len(left) :][near], return_index=True)
            for j in near[first].tolist():
                yield x[4], right[j][4]
            of[np.isin(of, met)] = of[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][:3] != row[:3]:
                    out += links(group)
                    group = []
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 2)], [*"ab"])
        if group and (out := [*links(group)]):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [*"ab"])

    return dealt.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "h").mapInArrow(run, "a long, b long")


def linked(ws: Workspace, prints: DataFrame, least: float = LEAST, small: int = BLOCK) -> DataFrame:
    """(a, b): verified links between the distinct prints(h, fingerprint), whose components are the classes: all that
    agree in a band and are near are in one.

    Every fingerprint is first held against the smallest of all its bands' smallest, then, where that doesn't connect them
    yet, against each band's smallest. Of a band that is still in several parts, all fingerprints of different parts are
    held against one another, in blocks of about `small`.
    """
    led = ws.keep(_led(_bands(prints)))
    # Bands of one family mostly have the same smallest member, so one pair for each fingerprint links most of them.
    one = led.where("h <> leader").groupBy(F.col("h").alias("b")).agg(F.min("leader").alias("a"))
    star = _verified(ws, one.select("a", "b"), prints, least)
    up = star.select(F.col("b").alias("a"), F.col("a").alias("top"))
    names = ws.keep(star.join(up, "a", "left").select(F.col("b").alias("h"), F.coalesce("top", "a").alias("of")))
    own = led.join(names, "h", "left").join(names.select(F.col("h").alias("leader"), F.col("of").alias("led")), "leader", "left")
    own = ws.keep(own.select("band", "h", "leader", F.coalesce("of", "h").alias("of"), F.coalesce("led", "leader").alias("led")))
    rest = _verified(ws, own.where("of <> led").select(F.col("leader").alias("a"), F.col("h").alias("b")), prints, least)
    mark = rest.select(F.col("a").alias("leader"), F.col("b").alias("h"), F.lit(True).alias("near"))
    of = own.join(mark, ["leader", "h"], "left").select("band", "h", F.when(F.col("near"), F.col("led")).otherwise(F.col("of")).alias("of"))
    whole = Window.partitionBy("band")
    sized = of.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("x", F.min("of").over(whole)).withColumn("y", F.max("of").over(whole))
    open_ = ws.keep(sized.where("x <> y").select("band", "h", "of", "n"))
    ws.drop(led, names, own)
    links = star.union(rest).union(ws.keep(_blocks(open_, prints, least, small)))
    return ws.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def class_ids(every: DataFrame, least: float = LEAST) -> DataFrame:
    """(did, t, class_id, n_links) of the rows of printed() that aren't alone in their class: the smallest doc_id of the
    class that is not null, and with how many other fingerprints a link of the row's own was verified. `every` is a written table.

    Rows with equal fingerprints are one class. Links are verified until they join a class, so one of m fingerprints has
    m - 1 or more, but not all that there are.
    """
    lone = F.min(F.when(F.col("did") != NO_ID, F.col("did"))).alias("first")
    with Workspace(every.sparkSession) as ws:
        prints = ws.keep(every.groupBy("h").agg(F.first("fingerprint").alias("fingerprint"), lone, F.count(F.lit(1)).alias("rows")))
        links = linked(ws, prints, least)
        names = components(links, ws=ws).toDF("h", "of")
        counts = links.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n_links"))
        named = ws.keep(prints.select("h", "first", "rows").join(names, "h", "left").join(counts, "h", "left").select("h", F.coalesce("of", "h").alias("of"), "first", "rows", F.coalesce("n_links", F.lit(0)).alias("n_links")))
        classes = named.groupBy("of").agg(F.min("first").alias("class_id"), F.sum("rows").alias("rows")).where("rows > 1").select("of", "class_id")
        mine = written(named.join(classes, "of").select("h", "class_id", "n_links"))
    return every.select("did", "t", "h").join(mine, "h").select("did", "t", "class_id", "n_links").distinct()
