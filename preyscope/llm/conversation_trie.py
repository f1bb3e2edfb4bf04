"""The prefix trie of conversations, by union-find over neighbours in sorted order.

A conversation is the sequence of its turns' digests, as one binary path. Paths are sorted over all partitions, copies
told apart by conv_id, so a group of copies has no task of its own. In blocks of sorted rows the edges between
neighbours, as deep as the prefix they share, join components in descending depth: each merge makes a branching node,
and what stands on the edge to it is a chain of nodes with the same members. Nodes that aren't on the way to a block's
first or last path are finished. The others, its two spines, are all that is kept of the block: forests are contracted
to them and merged, from block to block in a task and from partition to partition in further rounds of FAN each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

#: Conversations and turns of a block, whichever comes first.
BLOCK, BLOCK_TURNS = 8192, 200_000
#: Forests of so many neighbouring partitions are merged by one task.
FAN = 64
#: Bytes of a turn's digest.
TURN = 16
NOTHING = hashlib.sha256(b"").hexdigest()

NODE, FOREST, ENDS = 0, 1, 2
_ARRAYS = pa.list_(pa.list_(pa.int64()))
_FIELDS = [
    ("kind", pa.int64()), ("pid", pa.int64()), ("at", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("key", pa.string()), ("up", pa.string()),
    ("first", pa.binary()), ("last", pa.binary()), ("share", pa.int64()), ("left", _ARRAYS), ("right", _ARRAYS),
]
_ARROW = pa.schema(_FIELDS)
_SPARK = ", ".join(f"`{n}` {'array<array<long>>' if t == _ARRAYS else {pa.int64(): 'long', pa.string(): 'string', pa.binary(): 'binary'}[t]}" for n, t in _FIELDS)


class Open:
    """A node on a spine: its members so far, and sums over its finished children only."""

    __slots__ = ("kids", "key", "leaves", "low", "n", "saved", "words")

    def __init__(self, key: str, n: int, low: int, kids: int, leaves: int, saved: int, words: int) -> None:
        self.key, self.n, self.low, self.kids, self.leaves, self.saved, self.words = key, n, low, kids, leaves, saved, words


class Forest:
    """Contracted sorted conversations: nodes by depth towards the first and the last, the same ones up to depth `share`."""

    __slots__ = ("first", "last", "left", "right", "share")

    def __init__(self, first: bytes, last: bytes, share: int, left: list[Open], right: list[Open]) -> None:
        self.first, self.last, self.share, self.left, self.right = first, last, share, left, right


def keys(path: bytes) -> list[str]:
    """A name for each prefix of a path, from the empty one on."""
    running, out = hashlib.md5(usedforsecurity=False), []
    for at in range(0, len(path) + 1, TURN):
        out.append(running.hexdigest())
        running.update(path[at : at + TURN])
    return out


def shared(a: bytes, b: bytes) -> int:
    """The number of turns with which both paths begin."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * TURN : middle * TURN] == b[low * TURN : middle * TURN]:
            low = middle
        else:
            high = middle - 1
    return low


class Rows:
    """Collected rows of the output table."""

    def __init__(self) -> None:
        self.rows: list[dict[str, object]] = []

    def node(self, low: int, depth: int, parent: int | None, n: int, kids: int, leaves: int, saved: int, ends: str | None = None, key: str | None = None, up: str | None = None) -> None:
        self.rows.append({"kind": NODE, "conv_id": low, "depth": depth, "parent": parent, "n_convs": n, "n_children": kids, "n_leaves": leaves, "saved_tokens": saved, "ends": ends, "key": key, "up": up})

    def close(self, spine: list[Open], above: int) -> None:
        """Finishes the nodes of a spine deeper than `above`; their parent at that depth stays open, if there is one."""
        for depth in range(len(spine) - 1, above, -1):
            node = spine[depth]
            leaves, saved = node.leaves if node.kids else 1, node.saved + (node.n - 1) * node.words
            parent = spine[depth - 1] if depth else None
            stays = parent is not None and depth - 1 == above
            self.node(node.low, depth, None if stays or parent is None else parent.low, node.n, node.kids, leaves, saved, key=node.key, up=parent.key if stays else None)
            if parent is not None:
                parent.kids, parent.leaves, parent.saved = parent.kids + 1, parent.leaves + leaves, parent.saved + saved

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist(self.rows, _ARROW)
        self.rows = []
        return batch


def grow(paths: list[bytes], convs: list[int], words: list[list[int]], rows: Rows, pid: int, at: int) -> Forest:
    """The forest of one block of sorted conversations; finished nodes and the members that end at others go to rows."""
    starts = [k for k in range(len(paths)) if not k or paths[k] != paths[k - 1]]
    m = len(starts)
    path, n = [paths[k] for k in starts], [b - a for a, b in zip(starts, [*starts[1:], len(paths)], strict=True)]
    sums = []  # of words by depth
    for k in starts:
        total = [0]
        for w in words[k]:
            total.append(total[-1] + w)
        sums.append(total)
    # Nodes: the first m are the distinct paths, branching nodes follow.
    depth, low, member, up = [len(p) // TURN for p in path], [convs[k] for k in starts], list(range(m)), [-1] * m
    kids, leaves, saved = [0] * m, [0] * m, [0] * m
    root, end, top = list(range(m)), list(range(m)), list(range(m))  # of components, which are runs of paths

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def attach(y: int, x: int, spine: bool) -> None:
        up[y], n[x], low[x] = x, n[x] + n[y], min(low[x], low[y])
        if not spine:
            kids[x] += 1
            leaves[x] += leaves[y] if kids[y] else 1
            saved[x] += saved[y] + (n[y] - 1) * (sums[member[y]][depth[y]] - sums[member[y]][depth[x]])

    edges = [shared(a, b) for a, b in zip(path, path[1:], strict=False)]
    # Of equal depth from left to right: then a right component's top is always deeper than the edge.
    for k in sorted(range(m - 1), key=lambda k: -edges[k]):
        a, b, d = find(k), find(k + 1), edges[k]
        x, y = top[a], top[b]
        if depth[x] > d:
            z = len(depth)
            for values, v in ((depth, d), (low, low[x]), (member, member[x]), (up, -1), (n, 0), (kids, 0), (leaves, 0), (saved, 0)):
                values.append(v)
            attach(x, z, a == 0 or end[a] == m - 1)
            x = z
        attach(y, x, b == 0 or end[b] == m - 1)
        root[b], end[a], top[a] = a, end[b], x
    share = min(edges) if edges else depth[0]

    names = {0: keys(path[0]), m - 1: keys(path[-1])}
    spines: dict[int, list[Open]] = {}
    open_: dict[int, str] = {}
    for side, name in names.items():
        spine: list[Open] = []
        chain, k = [], side
        while k >= 0:
            chain.append(k)
            open_[k] = name[depth[k]]
            k = up[k]
        for k in reversed(chain):
            total = sums[side]
            for d in range(len(spine), depth[k]):
                spine.append(Open(name[d], n[k], low[k], 0, 0, 0, total[d] - total[d - 1] if d else 0))
            d = depth[k]
            spine.append(Open(name[d], n[k], low[k], kids[k], leaves[k], saved[k], total[d] - total[d - 1] if d else 0))
        spines[side] = spine
    left, right = spines[0], spines[0][: share + 1] + spines[m - 1][share + 1 :]

    for k in range(len(depth)):
        ids = b",".join(b"%d" % c for c in convs[starts[k] : starts[k] + n_own]) if k < m and (n_own := (starts[k + 1] if k + 1 < m else len(paths)) - starts[k]) else b""
        if k in open_:
            if k < m:
                rows.rows.append({"kind": ENDS, "pid": pid, "at": at, "key": open_[k], "ends": ids.decode()})
            continue
        x, total = up[k], sums[member[k]]
        parent, above = (None, open_[x]) if x in open_ else (low[x], None)
        tokens = saved[k] + (n[k] - 1) * (total[depth[k]] - total[depth[k] - 1])
        ends = hashlib.sha256(ids).hexdigest()
        tops = depth[k] == depth[x] + 1
        rows.node(low[k], depth[k], parent if tops else low[k], n[k], kids[k], leaves[k] if kids[k] else 1, tokens, ends, up=above if tops else None)
        for d in range(depth[k] - 1, depth[x], -1):
            tokens += (n[k] - 1) * (total[d] - total[d - 1])
            tops = d == depth[x] + 1
            rows.node(low[k], d, parent if tops else low[k], n[k], 1, leaves[k] if kids[k] else 1, tokens, NOTHING, up=above if tops else None)
    return Forest(path[0], path[-1], share, left, right)


def merge(a: Forest | None, b: Forest, rows: Rows) -> Forest:
    """The forest of a's conversations followed by b's; nodes that are on neither outer spine any more go to rows."""
    if a is None:
        return b
    d = shared(a.last, b.first)
    rows.close(a.right, max(d, a.share))
    rows.close(b.left, max(d, b.share))
    for k in range(d + 1):
        x, y = a.right[k], b.left[k]
        x.n, x.low, x.kids, x.leaves, x.saved = x.n + y.n, min(x.low, y.low), x.kids + y.kids, x.leaves + y.leaves, x.saved + y.saved
        if k <= b.share:
            b.right[k] = x
    if d > max(a.share, b.share):
        rows.close(a.right[: d + 1], max(a.share, b.share))
    return Forest(a.first, b.last, min(a.share, d, b.share), a.left, b.right)


def finish(a: Forest, rows: Rows) -> None:
    rows.close(a.left, a.share)
    if len(a.right) > a.share + 1:
        rows.close(a.right, a.share)
    rows.close(a.left[: a.share + 1], -1)


def _packed(a: Forest, pid: int) -> dict[str, object]:
    left, right = ([[x.n, x.low, x.kids, x.leaves, x.saved, x.words] for x in side] for side in (a.left, a.right[a.share + 1 :]))
    return {"kind": FOREST, "pid": pid, "first": a.first, "last": a.last, "share": a.share, "left": left, "right": right}


def _unpacked(row: dict) -> Forest:
    left, right = ([Open(name, *x) for name, x in zip(names, side, strict=True)] for names, side in ((keys(row["first"]), row["left"]), (keys(row["last"])[row["share"] + 1 :], row["right"])))
    return Forest(row["first"], row["last"], row["share"], left, left[: row["share"] + 1] + right)


def _grow_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pid, at, forest, rows = TaskContext.get().partitionId(), 0, None, Rows()
    for batch in batches:
        paths, convs, words = (batch.column(k).to_pylist() for k in range(3))
        start = 0
        while start < len(convs):
            stop, turns = start, 0
            while stop < len(convs) and stop - start < BLOCK and turns < BLOCK_TURNS:
                turns += len(words[stop]) + 1
                stop += 1
            forest = merge(forest, grow(paths[start:stop], convs[start:stop], words[start:stop], rows, pid, at), rows)
            start, at = stop, at + 1
            yield rows.take()
    if forest:
        rows.rows.append(_packed(forest, pid))
        yield rows.take()


def _merge_partitions(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Merges forests, which come in the order of group and partition."""
    group, forest, rows = None, None, Rows()

    def done() -> None:
        if forest and last:
            finish(forest, rows)
        elif forest:
            rows.rows.append(_packed(forest, group))

    for batch in batches:
        for row in batch.to_pylist():
            if row["g"] != group:
                done()
                group, forest = row["g"], None
            forest = merge(forest, _unpacked(row), rows)
        yield rows.take()
    done()
    yield rows.take()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and the hash of its texts, joined by commas; rows come in the order of the key."""
    key, running = None, hashlib.sha256()
    for batch in batches:
        names, hashes = [], []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k == key:
                running.update(b",")
            else:
                if key is not None:
                    names.append(key)
                    hashes.append(running.hexdigest())
                key, running = k, hashlib.sha256()
            running.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(hashes, pa.string())], ["key", "hash"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([running.hexdigest()])], ["key", "hash"])


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path (16 bytes a turn) and words (of each turn's text) of every rebuilt conversation.

    Turns are dealt by the conversation that lends its head, so lending needs no join. A conversation is one row of some
    24 bytes a turn; texts are never shuffled.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id is not null").select((F.col("conv_id") - F.col("conv_id") % 20).alias("base"), "conv_id", F.struct("turn", digest.alias("d"), n_words(F.col("text")).alias("w")).alias("t"))
    whole = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    head = F.max(F.when(F.col("base") == F.col("conv_id"), F.slice("t", 1, 3))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    lent = whole.select("conv_id", "t", head.alias("head"), h.alias("h"))
    own = F.when(F.size("t") > F.col("h"), F.slice("t", F.col("h") + 1, F.size("t"))).otherwise(F.slice("t", 1, 0))
    both = lent.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), own)).alias("t"))
    return both.select(F.unhex(F.array_join(F.col("t.d"), "")).alias("path"), F.col("conv_id").cast("long"), F.col("t.w").alias("words"))


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    conversations has conv_id, turn, role and text; other columns are not read. Rows without conv_id belong to no
    conversation and are left out; a null turn comes first, null roles and texts are empty. Rows of one conversation
    with the same turn are all turns of it, in the order of their digests: fixed, though not alphabetical; repeated rows
    are repeated turns. % has the sign of conv_id. An empty table has no conversations, hence no nodes. Texts of any
    length are read once, where they are; a conversation of very many turns has a row of 24 bytes a turn and gives a
    node a turn. Members that end at a node on a spine are hashed in order as a stream of pieces, in one task for each
    such node: SHA-256 can't be split.
    """
    ordered = rebuilt(conversations).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    tables = [written(ordered.mapInArrow(_grow_partition, _SPARK))]
    while True:
        forests = tables[-1].where(F.col("kind") == FOREST)
        last = (forests.agg(F.max("pid")).first()[0] or 0) < FAN
        grouped = forests.withColumn("g", F.floor(F.col("pid") / FAN)).repartition("g").sortWithinPartitions("g", "pid")
        tables.append(written(grouped.mapInArrow(lambda batches, last=last: _merge_partitions(batches, last), _SPARK)))
        if last:
            break
    nodes = tables[0].where(F.col("kind") == NODE)
    for t in tables[1:]:
        nodes = nodes.union(t.where(F.col("kind") == NODE))
    pieces = tables[0].where(F.col("kind") == ENDS).select("key", "ends", "pid", "at")
    hashes = pieces.repartition("key").sortWithinPartitions("key", "pid", "at").select("key", "ends").mapInArrow(_hashed, "key string, hash string")
    parents = nodes.where("key is not null").select(F.col("key").alias("up"), F.col("conv_id").alias("found"))
    columns = ["conv_id", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    # Joins get rows with a key only, so null keys meet nowhere.
    named = nodes.where("up is not null").join(parents, "up", "left").withColumn("parent", F.col("found")).select(*columns, "key").union(nodes.where("up is null").select(*columns, "key"))
    ended = named.where("key is not null").join(hashes, "key", "left").withColumn("ends", F.coalesce("hash", F.lit(NOTHING))).select(columns)
    return named.where("key is null").select(columns).union(ended).withColumnsRenamed({"parent": "parent_conv_id", "ends": "ends_sha256"})
