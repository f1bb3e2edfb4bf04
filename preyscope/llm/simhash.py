"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit for each of 64 positions, set where more than half of its shingle hashes have it. The
covering construction gives every bit position a non-zero vector of radius + 1 bits, and every non-zero vector v of
that length a mask of the positions whose vector has an odd inner product with v. Any `radius` positions leave some v
orthogonal to all their vectors, so two fingerprints that differ in at most `radius` bits agree under at least one of
the 2^(radius + 1) - 1 masks: no pair is missed. Fingerprints that share a masked value with others are then linked
within that value without listing pairs: see covering_links().
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut

BITS = 64
SEED = 42
SHINGLE = 3
RADIUS = 2
#: Fingerprints of more rows than this, and than a thousandth of all rows, are hot: a thousand at most, so these are broadcast.
HOT = 1000
#: Masked values of up to so many fingerprints are compared in a task: half a megabyte of differences at most.
GROUP = 256


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text as an unsigned number; 0 without words."""
    words = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    h, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        part = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[at : at + 65_536], stops[at : at + 65_536], strict=True)), np.uint64)
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp (the fingerprint as a signed long). Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = np.fromiter((fingerprint(texts[k].as_py() or "", shingle) for k in range(len(batch))), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["a", "b"])

    key = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"a {key}, b long").toDF("doc_id", "fp")


def masks(radius: int = RADIUS, seed: int = 1) -> list[int]:
    """The covering masks, each over all 64 positions: every vector is given to about as many positions."""
    vectors = [v for v in range(1, 1 << (radius + 1))]
    dealt = [vectors[k % len(vectors)] for k in range(BITS)]
    random.Random(seed).shuffle(dealt)
    return [sum(1 << k for k, m in enumerate(dealt) if (m & v).bit_count() % 2) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of x within the radius that connect its fingerprints as all such pairs do: fewer than there are in x."""
    near, fresh = np.bitwise_count(x[:, None] ^ x) <= radius, np.ones(len(x), bool)
    ones, others = [], []
    for root in range(len(x)):
        reached = [root] if fresh[root] else []
        fresh[root] = False
        for at in reached:
            found = np.flatnonzero(near[at] & fresh)
            fresh[found] = False
            reached += found.tolist()
            ones += found.tolist()
            others += [at] * len(found)
    return x[ones], x[others]


def _compared(left: DataFrame, radius: int) -> DataFrame:
    """(a, b): links within the groups of left(mask, key, fp), which are small: held against one another in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_forest(np.array(fps.as_py(), np.int64).view(np.uint64), radius) for fps in batch.column(0)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*found, strict=True)], ["a", "b"])

    return left.groupBy("mask", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps")).select("fps").mapInArrow(run, "a long, b long")


def covering_links(fps: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """(a, b), fingerprints within the radius of one another; connected as all pairs within it are.

    fps(fp) is distinct. Rows (table, masked value, fp) that stand alone are dropped by counting. Of what is left, values
    of up to `group` fingerprints are compared in a task, which gives out fewer links than fingerprints. In larger ones a
    fingerprint names what only those within the radius of it can name too, and each is linked to the smallest that names
    it: at radius 2 every value that differs from it in at most one of the bits outside the mask, at radius 1 every such
    bit with the value without it.
    """
    if radius not in (1, 2):
        raise ValueError("a radius of 1 or 2 is built")
    tables = [_signed(m) for m in masks(radius)]
    outside = [[_signed(1 << k) for k in range(BITS) if not (m >> k) & 1] for m in masks(radius)]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in tables])).alias("mask", "key"))
    shared = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    left = cut(keyed.join(shared, ["mask", "key"]))
    bits = F.get(F.array(*[F.array(*[F.lit(x).cast("long") for x in own]) for own in outside]), F.col("mask"))
    none = F.lit(0).cast("long")
    if radius == 2:
        names = F.transform(F.concat(F.array(none), bits), lambda x: F.struct(none.alias("place"), F.col("fp").bitwiseXOR(x).alias("value")))
    else:
        names = F.transform(bits, lambda x: F.struct(x.alias("place"), F.col("fp").bitwiseAND(F.bitwise_not(x)).alias("value")))
    large = left.where(F.col("n") > group).select("mask", "fp", F.inline(names))
    by = ["mask", "place", "value"]
    low = large.groupBy(*by).agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    named = large.join(low, by).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return named.union(_compared(left.where(F.col("n") <= group), radius)).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) for every row of docs.

    Fingerprints link at `radius` or fewer differing bits. Links are found between distinct fingerprints, so exact
    copies cost one row each; components come from checkpointed star steps. Texts without words, empty and null ones
    have fingerprint 0 and link like any other. Rows with a null doc_id count for the links but for no component_id.
    """
    found = cut(fingerprints(docs, shingle))
    own = cut(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    groups = components(covering_links(own.select("fp"), radius)).withColumnRenamed("node", "fp")
    classes = own.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    low = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = cut(classes.join(low, "component").select("fp", "component_id", "n"))
    total = own.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(HOT, total // 1000)
    common, rest = F.broadcast(named.where(hot).drop("n")), named.where(~hot).drop("n")
    rows = found.join(common, "fp").unionByName(found.join(common.select("fp"), "fp", "left_anti").join(rest, "fp"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
