"""Scores that borrow support from neighbouring preys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import Workspace, cut, stored, tasks_of
from . import scoring

GAMMA_LIMIT = 10.0

#: Baits whose labels go along an edge in one row.
BLOCK = 8

#: Pairs with their cells, or cells, that a task of a round takes, with what its neighbours bring.
PAIRS_OF_A_TASK = 250_000

#: Preys of a term that are paired in one task; larger terms are dealt over several.
TERM_PREYS = 1000


def edges_from_terms(terms: DataFrame, preys: DataFrame) -> DataFrame:
    """(a, b), a < b: preys that share a term of terms(term, members), members separated by blanks.

    The pairs of a term are the result, so a term that names most preys has their square; its preys are dealt by hash,
    each part with a copy of all the term's preys, so that no task pairs more than TERM_PREYS with them.
    """
    rows = cut(terms.select("term", F.explode(F.array_distinct(F.split("members", " +"))).alias("prey")).join(preys.select("prey").distinct(), "prey", "left_semi"))
    parts = rows.groupBy("term").agg((F.floor(F.count(F.lit(1)) / TERM_PREYS) + 1).alias("parts"))
    sized = rows.join(parts, "term")
    left = sized.select("term", F.pmod(F.xxhash64("prey"), F.col("parts")).alias("part"), F.col("prey").alias("a"))
    right = sized.select("term", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("prey").alias("b"))
    return left.join(right, ["term", "part"]).where("a < b").select("a", "b").distinct()


def edges_from_pairs(pairs: DataFrame, preys: DataFrame) -> DataFrame:
    """(a, b), a < b: known prey pairs(a, b) in either direction, without self-pairs and unknown preys.

    Pairs move twice, by each of their ends, and are told apart on the way.
    """
    known = stored(preys.select("prey").distinct())
    rows = stored(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    tasks = max(tasks_of(rows), tasks_of(known))
    for c in ("a", "b"):
        ends = known.withColumnRenamed("prey", c).repartition(tasks, c).hint("shuffle_hash")
        rows = rows.repartition(tasks, c).join(ends, c, "left_semi").select("a", "b")
        rows = rows.distinct() if c == "a" else rows
    return rows


def neighbour_support(labelled: DataFrame, edges: DataFrame, symmetric: bool = False) -> DataFrame:
    """(prey, bait, support, neighbours): sum over the prey's neighbours of their mean label with the bait, and the
    neighbours with a true label. labelled: prey, bait, z. Edges count from the smaller to the larger prey, or both ways."""
    return _support(labelled.groupBy("prey", "bait").agg(F.avg(F.col("z").cast("double")).alias("z")), stored(_both(edges) if symmetric else edges))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()


def _support(means: DataFrame, edges: DataFrame) -> DataFrame:
    """neighbour_support() of means(prey, bait, z) over a written table of edges."""
    tasks = tasks_of(edges)
    near = edges.repartition(tasks, "b").select(F.col("a").alias("prey"), F.col("b").alias("other"))
    met = near.join(means.where("z > 0").select(F.col("prey").alias("other"), "bait", "z"), "other")
    return met.repartition(tasks, "prey").groupBy("prey", "bait").agg(F.sum("z").alias("support"), F.array_join(F.sort_array(F.collect_set("other")), "|").alias("neighbours"))


def colour(edges: DataFrame) -> DataFrame:
    """(prey, colour) such that no two ends of an edge have the same colour, counted from 0.

    In each round the preys whose hash is greater than those of all their neighbours without a colour take the least
    colour that no neighbour has. Rounds grow slowly with the preys; each writes what changed, and edges between preys
    without a colour are all that the next one compares.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("name"))
    with Workspace(edges.sparkSession) as ws:
        every = ws.keep(_both(edges))
        open_, done, n = every, [], 1
        while n:
            first = open_.groupBy("a").agg(F.max(rank("b")).alias("top")).where(rank("a") > F.col("top")).select(F.col("a").alias("prey"))
            if done:
                before = reduce(DataFrame.union, done)
                # Preys all of whose neighbours have a colour are in no open edge.
                last = every.select(F.col("a").alias("prey")).distinct().join(open_.select(F.col("a").alias("prey")), "prey", "left_anti").join(before.select("prey"), "prey", "left_anti")
                first = ws.keep(first.union(last))
                used = every.join(first.withColumnRenamed("prey", "a"), "a", "left_semi").join(before.select(F.col("prey").alias("b"), "colour"), "b").groupBy(F.col("a").alias("prey")).agg(F.collect_set("colour").alias("used"))
                free = F.array_except(F.sequence(F.lit(0), F.coalesce(F.size("used"), F.lit(0))), F.coalesce("used", F.array().cast("array<int>")))
                new = ws.keep(first.join(used, "prey", "left").select("prey", F.array_min(free).alias("colour")))
            else:
                new = ws.keep(first.select("prey", F.lit(0).alias("colour")))
            n = new.count()
            done.append(new)
            for end in ("a", "b"):
                open_ = open_.join(new.select(F.col("prey").alias(end)), end, "left_anti").select("a", "b")
            open_ = ws.keep(open_)
        return cut(reduce(DataFrame.union, done))


def update_labels(ws: Workspace, cells: DataFrame, edges: DataFrame, means: list[DataFrame], beta: float, gamma: float) -> list[DataFrame]:
    """means by colour, (prey, bait, z, support, neighbours), after one update of every label, colour by colour.

    cells(prey, bait, lt, lf, colour) and edges(a, b, colour of a) are sorted by colour, so each step reads its own part
    of them. Preys of one colour are no neighbours: their labels change together as they would one after the other, and
    each change raises the joint likelihood or leaves it.
    """
    out = list(means)
    for c in range(len(means)):
        near = _support(reduce(DataFrame.union, [m.select("prey", "bait", "z") for m in out]), edges.where(F.col("colour") == c))
        rows = cells.where(F.col("colour") == c).join(near, ["prey", "bait"], "left").withColumn("support", F.coalesce("support", F.lit(0.0)))
        z = F.lit(beta) + gamma * F.col("support") + F.col("lt") - F.col("lf") >= 0
        new = ws.keep(rows.groupBy("prey", "bait").agg(F.avg(z.cast("double")).alias("z"), F.first("support").alias("support"), F.first("neighbours").alias("neighbours")))
        old, out[c] = out[c], new
        ws.drop(old)
    return out


def fit_beta_gamma(pairs: DataFrame) -> tuple[float, float]:
    """(beta, gamma) that maximise sum z (beta + gamma s) - ln(1 + e^(beta + gamma s)) over pairs(z, support).

    Pairs collapse to a histogram by support (rounded to 6 digits), which is written; each Newton step within the limits
    is an aggregate over it for the slopes and one for all step lengths at once. gamma is 0 unless it helps.
    """
    grid = cut(pairs.groupBy(F.round("support", 6).alias("s")).agg(F.sum("z").alias("z"), F.count(F.lit(1)).alias("n")))
    whole = grid.agg(F.sum("z").alias("z"), F.sum("n").alias("n")).first()
    if not whole.n:
        return 0.0, 0.0
    s, z, n = F.col("s"), F.col("z"), F.col("n")

    def values(at: list[tuple[float, float]]) -> list[float]:
        odds = [F.lit(b) + g * s for b, g in at]
        return [*grid.agg(*[F.sum(z * x - n * (F.greatest(F.lit(0.0), x) + F.log1p(F.exp(-F.abs(x))))).alias(f"v{k}") for k, x in enumerate(odds)]).first()]

    start = scoring.beta_of(whole.z / whole.n)
    b, g = start, 0.0
    first = now = values([(b, g)])[0]
    for _ in range(100):
        q = 1 / (1 + F.exp(-(F.lit(b) + g * s)))
        w = n * q * (1 - q) + 1e-12
        t = grid.agg(F.sum(z - n * q).alias("b"), F.sum(s * (z - n * q)).alias("g"), F.sum(w).alias("bb"), F.sum(w * s).alias("bg"), F.sum(w * s * s).alias("gg")).first()
        det = t.bb * t.gg - t.bg * t.bg
        if det <= 1e-12:
            break
        step_b, step_g = (t.gg * t.b - t.bg * t.g) / det, (t.bb * t.g - t.bg * t.b) / det
        sizes = [0.5**k for k in range(20)]
        at = [(max(-scoring.BETA_LIMIT, min(scoring.BETA_LIMIT, b + x * step_b)), max(0.0, min(GAMMA_LIMIT, g + x * step_g))) for x in sizes]
        better = next(((p, v) for p, v in zip(at, values(at), strict=True) if v > now), None)
        if better is None:
            break
        moved = abs(better[0][0] - b) + abs(better[0][1] - g)
        (b, g), now = better
        if moved < 1e-9:
            break
    return (b, g) if now > first else (start, 0.0)


def topology_scores(cells: DataFrame, edges: DataFrame, pairs: DataFrame, n_replicates: int = 100, rounds: int = 5, symmetric: bool = False) -> DataFrame:
    """pairs(prey, bait, avg_p, ...) with topo_avg_p, score = the greater of both, and boosted_by.

    cells are a written table of a model's replicate cells (lt, lf, z0, skip, y), a row each or, with skip, an array of
    each pair. Labels and (beta, gamma) take turns. Edges that count one way, from the smaller to the larger prey, let a
    prey depend on later ones only: then updating all labels of a round at once is the same as one prey after the other
    in order. Where they count both ways, labels that change at once can swing between two states; there the preys are
    coloured and updated colour by colour.
    """
    if symmetric:
        flat = cells.select("prey", "bait", "skip", F.inline("cells")) if "cells" in cells.columns else cells
        rows, beta, gamma = _by_colour(flat, edges, rounds)
        rows = rows.groupBy("prey", "bait").agg(F.collect_list(F.struct("lt", "lf", _seen(F.col("y")))).alias("cells"), F.first("support").alias("support"), F.first("neighbours").alias("neighbours"))
    else:
        rows, beta, gamma = _at_once(cells, edges, rounds)
    # The n best replicate scores, as in scoring.aggregate_replicates(); a cell that was not seen has none.
    scores = F.transform("cells", lambda x: F.when(x["seen"], 1 / (1 + F.exp(-_odds(x, beta, gamma)))).otherwise(0.0))
    best = F.slice(F.sort_array(F.filter(scores, lambda x: x.isNotNull()), asc=False), 1, n_replicates)
    topo = rows.select("prey", "bait", (F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best)).alias("topo_avg_p"), F.col("neighbours").alias("boosted_by"))
    return pairs.join(topo, ["prey", "bait"], "left").withColumn("score", F.greatest("topo_avg_p", "avg_p"))


def _seen(y: Column) -> Column:
    return (F.coalesce(y, F.lit(0.0)) != 0).alias("seen")


def _odds(cell: Column, beta: float, gamma: float) -> Column:
    return F.lit(beta) + gamma * F.col("support") + cell["lt"] - cell["lf"]


def _by_pair(cells: DataFrame) -> DataFrame:
    """A row for each (prey, bait) with its cells (lt, lf, z0, skip, seen), the number of those with a label (n) and of those that count for the fit (live)."""
    cell = lambda x: F.struct(x("lt").alias("lt"), x("lf").alias("lf"), x("z0").alias("z0"), F.col("skip").alias("skip"), _seen(x("y")))
    found = F.transform("cells", lambda x: cell(lambda c: x[c])) if "cells" in cells.columns else F.array(cell(F.col))
    rows = cells.select("prey", "bait", found.alias("cells")).groupBy("prey", "bait").agg(F.flatten(F.collect_list("cells")).alias("cells")).where(F.size("cells") > 0)
    return rows.withColumn("n", F.size(F.filter("cells", lambda x: (x["lt"] - x["lf"]).isNotNull()))).withColumn("live", F.size(F.filter("cells", lambda x: ~x["skip"])))


def _places(cells: DataFrame) -> DataFrame:
    """(bait, block, place): baits in blocks of BLOCK, to broadcast."""
    rows = cells.select("bait").where("bait is not null").distinct().coalesce(1).select("bait", F.monotonically_increasing_id().alias("at"))
    return rows.select("bait", F.floor(F.col("at") / BLOCK).alias("block"), (F.col("at") % BLOCK).cast("int").alias("place"))


def _of_place(columns: list[Column]) -> Column:
    """That column of a block that belongs to the row's place."""
    return F.coalesce(*[F.when(F.col("place") == k, c) for k, c in enumerate(columns)])


def _gathered(means: DataFrame, edges: DataFrame, tasks: int, names: bool) -> DataFrame:
    """(prey, block, s0.., and n0.. if `names`): for each place of the block the sum of the neighbours' mean labels and
    the neighbours with a true one. means(prey, block, place, z); edges are dealt by b to as many tasks.

    What an edge brings is a row for each block of baits, not for each bait.
    """
    places = range(BLOCK)
    labels = means.where("z > 0 and block is not null").repartition(tasks, "prey").groupBy(F.col("prey").alias("b"), "block").agg(*[F.max(F.when(F.col("place") == k, F.col("z"))).alias(f"z{k}") for k in places])
    met = edges.join(labels.hint("shuffle_hash"), "b").select(F.col("a").alias("prey"), "block", *["b"] * names, *[f"z{k}" for k in places]).repartition(tasks, "prey", "block")
    sets = [F.collect_set(F.when(F.col(f"z{k}").isNotNull(), F.col("b"))).alias(f"n{k}") for k in places] if names else []
    return met.groupBy("prey", "block").agg(*[F.sum(f"z{k}").alias(f"s{k}") for k in places], *sets)


def _at_once(cells: DataFrame, edges: DataFrame, rounds: int) -> tuple[DataFrame, float, float]:
    """(a row for each (prey, bait) with its cells and the support and neighbours of the last labels, beta, gamma).

    Pairs and edges are dealt once, so that a round moves only labels, along edges.
    """
    beta = gamma = 0.0
    share = lambda found, of: F.size(found) / F.nullif(of, F.lit(0))
    with Workspace(cells.sparkSession) as ws:
        tasks = tasks_of(cells, PAIRS_OF_A_TASK)
        edges = ws.deal(edges.select("a", "b"), tasks, "b")
        if (most := tasks_of(edges)) > 4 * tasks:
            tasks, edges = most, ws.deal(edges, most, "b")
        state = ws.deal(_by_pair(cells).join(F.broadcast(ws.keep(_places(cells))), "bait", "left"), tasks, "prey", "block")
        means = state.select("prey", "block", "place", share(F.filter("cells", lambda x: x["z0"]), F.size(F.filter("cells", lambda x: x["z0"].isNotNull()))).alias("z"))
        rows = state.withColumn("support", F.lit(0.0)).withColumn("neighbours", F.lit(None).cast("string"))
        if not rounds:
            rows = stored(rows)
        for k in range(rounds):
            # Only the last round's neighbours are reported, so only that one gathers their names.
            last = k == rounds - 1
            rows = state.join(_gathered(means, edges, tasks, last).hint("shuffle_hash"), ["prey", "block"], "left")
            rows = rows.withColumn("support", F.coalesce(_of_place([F.col(f"s{i}") for i in range(BLOCK)]), F.lit(0.0)))
            if last:
                named = _of_place([F.col(f"n{i}") for i in range(BLOCK)])
                rows = rows.withColumn("neighbours", F.when(F.size(named) > 0, F.array_join(F.sort_array(named), "|")))
            true = lambda x: _odds(x, beta, gamma) >= 0
            live = F.filter("cells", lambda x: ~x["skip"])
            part = share(F.filter(live, true), F.size(F.filter(live, lambda x: true(x).isNotNull())))
            rows = rows.withColumn("z", share(F.filter("cells", true), F.col("n"))).withColumn("live_z", F.when(F.col("live") == F.size("cells"), F.col("z")).when(F.col("live") > 0, part))
            kept = ["prey", "bait", "block", "place", "z", "live", "live_z", "support"]
            rows = stored(rows.select(*kept, "cells", "neighbours")) if last else ws.keep(rows.select(kept))
            means = rows.select("prey", "block", "place", "z")
            beta, gamma = fit_beta_gamma(rows.where("live > 0").select(F.col("live_z").alias("z"), "support"))
        return rows.select("prey", "bait", "cells", "support", "neighbours"), beta, gamma


def _by_colour(cells: DataFrame, edges: DataFrame, rounds: int) -> tuple[DataFrame, float, float]:
    """(cells with the support and neighbours of the last labels, beta, gamma); preys without edges have a colour of their own."""
    with Workspace(cells.sparkSession) as ws:
        colours = colour(edges)
        both = _both(edges)
        n = (colours.agg(F.max("colour")).first()[0] if not colours.isEmpty() else -1) + 2
        tinted = ws.keep(cells.join(colours, "prey", "left").withColumn("colour", F.coalesce("colour", F.lit(n - 1))), sort="colour")
        both = ws.keep(both.join(colours.withColumnRenamed("prey", "a"), "a"), sort="colour")
        none = F.lit(None).cast("string").alias("neighbours")
        start = tinted.groupBy("colour", "prey", "bait").agg(F.avg(F.col("z0").cast("double")).alias("z"))
        means = [start.where(F.col("colour") == c).select("prey", "bait", "z", F.lit(0.0).alias("support"), none) for c in range(n)]
        skipped = ws.keep(cells.groupBy("prey", "bait").agg(F.bool_or("skip").alias("skip")))
        beta = gamma = 0.0
        for _ in range(rounds):
            means = update_labels(ws, tinted, both, means, beta, gamma)
            beta, gamma = fit_beta_gamma(reduce(DataFrame.union, means).join(skipped.where("not skip"), ["prey", "bait"], "left_semi").select("z", "support"))
        near = _support(reduce(DataFrame.union, [m.select("prey", "bait", "z") for m in means]), both)
        return cut(cells.join(near, ["prey", "bait"], "left").withColumn("support", F.coalesce("support", F.lit(0.0)))), beta, gamma
