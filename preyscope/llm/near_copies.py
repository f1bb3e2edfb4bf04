"""Near copies: pairs of texts whose word shingles are alike, by SimHash covering tables and bands of minima, verified.

The covering tables of simhash.py, over fingerprints of the same shingles, find all pairs within their radius. Sets of
similarity 0.8 differ in about 10 of 64 bits, where the covering construction would need 2^11 tables; so pairs that are
further apart are found by bands of ROWS minima of random permutations. A pair of similarity s shares none of BANDS
bands with a chance of (1 - s^ROWS)^BANDS: 7 in 100,000 at 0.8, and less above. Every pair of either is held against the
texts' whole sets.

A family of m copies would have m^2 / 2 candidates. So each text that shares a band is first verified with one leader.
Texts of a band that are in different components after that are compared by a second, independent sketch of SKETCH minima
of a byte each, in blocks: texts of a common template that are no copies cost a comparison of bytes and no row. Pairs that
it is sure of are verified where they join parts. Texts with pairs that it leaves open meet once more, with their whole
sets, in blocks of the band, which hold these pairs against one another and give out only links that join parts. So rows
grow with the texts and their bands, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import Workspace
from . import simhash
from .common import components, cut, written

SHINGLE = 5
LEAST = 0.8
#: Bands, and minima in each.
BANDS, ROWS = 24, 5
#: Keys of texts to verify are broadcast up to so many, 8 bytes each; beyond, texts are shuffled.
BROADCAST_KEYS = 1_000_000
#: Minima of the second sketch, and the share of equal ones from which a pair is verified: at a similarity of 0.8 it has
#: a standard deviation of 0.0177, so 0.73 is four below; pairs of 0.6 reach it with a chance of 10^-9.
SKETCH, PLAUSIBLE = 512, 0.73
#: Four deviations above 0.8: of such pairs only those that join parts of a block are candidates.
SURE = 0.87
#: Texts of a block, and hashes of a block of whole sets; two blocks of a band meet in a task, a text against all at a time.
BLOCK, HASHES = 2048, 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
POSTING = "g long, key long, n int"
_rng = np.random.default_rng(31)
_TIMES, _PLUS = (_rng.integers(1, 1 << 63, (BANDS * ROWS, 1), np.uint64) | np.uint64(1) for _ in range(2))
_TIMES_2, _PLUS_2 = (_rng.integers(1, 1 << 63, (SKETCH, 1), np.uint64) | np.uint64(1) for _ in range(2))


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's runs of words, ascending; a shorter text is one run."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    m = max(1, len(w) - shingle + 1)
    out = np.zeros(m, np.uint64)
    for k in range(min(shingle, len(w))):
        out = (out ^ w[k : k + m]) * _ODD
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _minima(own: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    least = np.full(len(times), ~np.uint64(0))
    for at in range(0, len(own), 4096):
        x = own[None, at : at + 4096] * times + plus
        x ^= x >> np.uint64(31)
        least = np.minimum(least, (x * _ODD).min(1))
    return least


def sketch(own: np.ndarray) -> np.ndarray:
    """A byte of each of SKETCH minima of a set of hashes."""
    return (_minima(own, _TIMES_2, _PLUS_2) * _ODD >> np.uint64(56)).astype(np.uint8)


def bands(own: np.ndarray) -> np.ndarray:
    """The bands of a set of hashes: minima of BANDS * ROWS permutations, mixed by the row."""
    least = _minima(own, _TIMES, _PLUS)
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * _ODD
        out ^= out >> np.uint64(29)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("key"), text.alias("text"))


def _postings(texts: DataFrame, shingle: int) -> DataFrame:
    """POSTING: the bands of every text, its key and the size of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, own = batch.column(0).to_numpy(zero_copy_only=False), [shingles(t.as_py(), shingle) for t in batch.column(1)]
            if own:
                columns = [np.concatenate([bands(x) for x in own]).view(np.int64), np.repeat(keys, BANDS), np.repeat(np.array([len(x) for x in own], np.int32), BANDS)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*"abc"])

    return texts.mapInArrow(run, POSTING)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first, each group whole and at least two rows long."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        if not len(own[0]):
            continue
        held.append(own)
        if held[0][0][0] == own[0][-1]:
            continue
        own = [np.concatenate([h[k] for h in held]) for k in range(len(own))]
        last = int(np.searchsorted(own[0], own[0][-1]))
        held = [[c[last:] for c in own]]
        yield from _split([c[:last] for c in own])
    if held:
        yield from _split([np.concatenate([h[k] for h in held]) for k in range(len(held[0]))])


def _split(own: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    bounds = np.flatnonzero(np.diff(own[0])) + 1
    starts, stops = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(own[0])]])
    for k in np.flatnonzero(stops - starts > 1):
        yield [c[starts[k] : stops[k]] for c in own]


def _batched(run: Callable[[list[np.ndarray]], Iterator[list[np.ndarray]]], names: str) -> Callable:
    """A function of a group as one of batches, its rows gathered to batches of some size."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for group in _groups(parts):
            for rows in run(group):
                held.append(rows)
                n += len(rows[0])
                if n >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], [*names])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], [*names])

    return batches


def _led(postings: DataFrame, least: float) -> DataFrame:
    """Postings of bands that several texts share, with `leader`: the smallest text of a size near enough."""

    def run(group: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        fresh = np.concatenate([[True], np.diff(group[1]) != 0]) if len(group[1]) else np.zeros(0, bool)
        g, key, n = (c[fresh] for c in group)
        if len(g) < 2:
            return
        order = np.lexsort((key, n))
        g, key, n = g[order], key[order], n[order]
        leader, at = np.empty_like(key), 0
        while at < len(n):
            stop = int(np.searchsorted(n, n[at] / least + 1e-9, "right"))
            leader[at:stop] = key[at]
            at = stop
        yield [g, key, n, leader]

    return postings.repartition("g").sortWithinPartitions("g", "key").mapInArrow(_batched(run, "abcd"), f"{POSTING}, leader long")


def _covered(texts: DataFrame, shingle: int) -> DataFrame:
    """(a, b): texts with one SimHash fingerprint, each with the smallest, and the smallest of linked fingerprints."""
    prints = cut(simhash.fingerprints(texts.select(F.col("key").alias("doc_id"), "text"), shingle).toDF("key", "fp").distinct())
    own = cut(prints.groupBy("fp").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")))
    same = prints.join(own.where("n > 1"), "fp").where("key <> first").select("key", "first")
    links = simhash.covering_links(own.select("fp"))
    first = lambda c: own.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
    near = links.join(first("a"), "a").join(first("b"), "b").select("a_first", "b_first")
    return same.union(near).toDF("a", "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _sketches(texts: DataFrame, keys: DataFrame, shingle: int) -> DataFrame:
    """(key, sketch) of the texts with these keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sketch(shingles(t.as_py(), shingle)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], [*"ab"])

    return texts.join(keys, "key", "left_semi").mapInArrow(run, "key long, sketch binary").dropDuplicates(["key"])


def _dealt(open_: DataFrame, own: DataFrame, blocks: Column) -> DataFrame:
    """open_(g, key, n, of, ...) with own(key, ...), a band's texts dealt to blocks by hash: each two blocks of a band are
    a group of rows (pair, key, g, n, of, own, low, high, ...)."""
    dealt = open_.withColumn("own", F.pmod(F.xxhash64("key", F.lit(1)), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("g", "key", "n", "of", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).join(own, "key")
    dealt = dealt.select(F.xxhash64("g", "low", "high").alias("pair"), "key", "g", "n", "of", "own", "low", "high", *own.columns[1:])
    return dealt.repartition("pair").sortWithinPartitions("pair", "key")


def _plausible(group: list[np.ndarray], of: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each text of the lower block with those of the other that `of` has in other parts by then and whose sizes and
    sketches leave the similarity open, and the shares of equal minima."""
    n, own, low, high, packed = group[3].astype(np.int64), *group[5:9]
    drawn, right = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, SKETCH), np.flatnonzero(own == high)
    for i in np.flatnonzero(own == low).tolist():
        j = right[right > i] if low[0] == high[0] else right
        j = j[(of[j] != of[i]) & (np.minimum(n[j], n[i]) + 1e-6 >= least * np.maximum(n[j], n[i]))]
        share = (drawn[j] == drawn[i]).mean(1) if len(j) else np.zeros(0)
        near = share >= PLAUSIBLE + least - LEAST
        if near.any():
            yield i, j[near], share[near]


def _compared(open_: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """(g, a, b) of open_(g, key, n, of, rows): the pairs of a band that the sketch is sure of, where they join parts of
    two blocks; and without a b, the texts of pairs in different parts that it leaves open."""

    def run(group: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        key, g, of = group[1], group[2], group[4].copy()
        unsure: list[np.ndarray] = []
        for i, j, share in _plausible(group, of, least):
            sure = j[share >= SURE + least - LEAST]
            parts, first = np.unique(of[sure], return_index=True)
            out = sure[first]
            of[np.isin(of, parts)] = of[i]
            if len(out):
                yield [g[out], np.minimum(key[i], key[out]), np.maximum(key[i], key[out]), np.ones(len(out), bool)]
            rest = j[(share < SURE + least - LEAST) & (of[j] != of[i])]
            if len(rest):
                unsure.append(np.append(rest, i))
        if unsure:
            texts = np.unique(np.concatenate(unsure))
            yield [g[texts], key[texts], key[texts], np.zeros(len(texts), bool)]

    out = _dealt(open_, sketches, F.floor(F.col("rows") / BLOCK) + 1).mapInArrow(_batched(run, "abcd"), "g long, a long, b long, sure boolean")
    return out.select("g", "a", F.when(F.col("sure"), F.col("b")).alias("b"))


def _sure(compared: DataFrame) -> DataFrame:
    return compared.where("b is not null").select("a", "b").distinct()


def _between(open_: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """(a, b): the candidates of _compared(); a family that no leader links costs about a row a text."""
    return _sure(_compared(open_, sketches, least))


def _settled(unsure: DataFrame, sketches: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): verified links that join the texts of unsure(g, key, n, of) as all their pairs do that share a band g and
    that the sketch leaves open. Pairs are held against whole sets in the first of the bands that they share."""

    def run(group: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        key, g, of = group[1], group[2][0].astype(np.int64).view(np.uint64), group[4].copy()
        own = [np.frombuffer(x, np.uint64) for x in group[9]]
        banded = np.array([bands(x) for x in own])
        for i, j, _ in _plausible(group, of, least):
            same = banded[j] == banded[i]
            for k in j[banded[i][same.argmax(1)] == g].tolist():
                if of[k] == of[i]:
                    continue
                both = len(np.intersect1d(own[i], own[k], assume_unique=True))
                if both + 1e-9 >= least * (len(own[i]) + len(own[k]) - both):
                    of[of == of[k]] = of[i]
                    yield [np.minimum(key[i : i + 1], key[k]), np.maximum(key[i : i + 1], key[k])]

    sized = unsure.groupBy("g").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("hashes"))
    blocks = F.floor(F.greatest(F.col("rows") / BLOCK, F.col("hashes") / HASHES)) + 1
    return _dealt(unsure.join(sized, "g"), sketches.join(sets.toDF("key", "whole"), "key"), blocks).mapInArrow(_batched(run, "ab"), "a long, b long").distinct()


def _sets(ws: Workspace, texts: DataFrame, keys: DataFrame, shingle: int) -> DataFrame:
    """(key, own): the whole sets of the texts with these keys."""
    named = ws.keep(keys.distinct())
    keys = F.broadcast(named) if named.count() <= BROADCAST_KEYS else named

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py(), shingle).tobytes() for t in batch.column(1)], pa.binary())], [*"ab"])

    out = ws.keep(texts.join(keys, "key", "left_semi").mapInArrow(gather, "key long, own binary").dropDuplicates(["key"]))
    ws.drop(named)
    return out


def _verified(ws: Workspace, pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """pairs(a, b) of texts whose shingle sets have at least that similarity."""
    pairs = ws.keep(pairs)
    sets = _sets(ws, texts, pairs.select(F.col("a").alias("key")).union(pairs.select("b")), shingle)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                good.append(both + 1e-9 >= least * (len(u) + len(v) - both))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], [*"ab"])

    both = pairs.join(sets.toDF("a", "x").hint("merge"), "a").join(sets.toDF("b", "y").hint("merge"), "b")
    out = ws.keep(both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"))
    ws.drop(pairs, sets)
    return out


def near_copies(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(key, component) of the texts (xxhash64 of the text, null as empty) that have a near copy.

    Components chain over pairs whose similarity is at least `least`, every one of them verified. What is written on the
    way goes when the components are there.
    """
    texts = _keyed(docs)
    with Workspace(docs.sparkSession) as ws:
        led = ws.keep(_led(_postings(texts, shingle), least))
        pairs = led.where("key <> leader").select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).union(_covered(texts, shingle))
        first = _verified(ws, pairs.distinct(), texts, shingle, least)
        names = ws.keep(components(first, ws=ws).toDF("key", "of"))
        rows = led.drop("leader").join(names, "key", "left").select("g", "key", "n", F.coalesce("of", "key").alias("of"))
        several = rows.groupBy("g").agg(F.min("of").alias("x"), F.max("of").alias("y"), F.count(F.lit(1)).alias("rows")).where("x <> y").select("g", "rows")
        open_ = ws.keep(rows.join(several, "g"))
        ws.drop(led, names)
        sketches = ws.keep(_sketches(texts, open_.select("key").distinct(), shingle))
        compared = ws.keep(_compared(open_, sketches, least))
        sure = _verified(ws, _sure(compared), texts, shingle, least)
        left = compared.where("b is null").select("g", F.col("a").alias("key")).distinct()
        unsure = ws.keep(open_.select("g", "key", "n", "of").distinct().join(left, ["g", "key"]))
        rest = ws.keep(_settled(unsure, sketches, _sets(ws, texts, unsure.select("key"), shingle), least))
        return written(components(first.union(sure).union(rest), ws=ws).toDF("key", "component"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """One row of docs for each group of near copies: the smallest doc_id (null last), then the smallest key of its text.

    Rows are told apart by doc_id and text, so different texts with one doc_id stay, and so does a row without a doc_id
    that no other row is a copy of. Of rows with the same doc_id and text, the one whose other columns, as JSON, come
    first stays. Null and empty texts are
    copies of one another, as are texts of blanks; very long texts are compared whole; an empty table gives an empty one.
    """
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = docs.select(key.alias("key"), "doc_id").distinct()
    named = own.join(near_copies(docs, shingle, least), "key", "left").withColumn("component", F.coalesce("component", "key"))
    best = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m"))
    best = best.select(F.col("m.doc_id").alias("_d"), F.col("m.key").alias("_k"))
    kept = docs.withColumn("_key", key).join(best, (F.col("_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d"))).drop("_d", "_k")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*[F.col(f"`{c}`") for c in others])) if others else F.lit("")
    # The first row of each is found within the tasks before rows of one id and text meet.
    first = Window.partitionBy("doc_id", "_key").orderBy(order, F.col("text").asc_nulls_first())
    return kept.withColumn("_row", F.row_number().over(first)).where("_row = 1").drop("_row", "_key")
