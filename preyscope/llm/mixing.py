"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are put in a pseudo-random order and laid end to end; the stream is cut into blocks of the
same number of words. A schedule of slots names a source each: slot s stands at the golden-ratio point frac(s * phi)
and falls to the source whose stretch of the cumulative target weights holds that point. The k-th slot of a source
takes its k-th block, from the start again after the last, so sources are interleaved evenly at every scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

WEIGHTS = (5, 2, 1)
#: No source's target is above so many times its size.
MOST = 3
#: About so many slots make up the schedule at any input size: a block is a millionth of all words.
SLOTS = 1 << 20
#: Slots are numbered within runs of so many, then from run to run.
RUN = 4096
#: 2^32 / phi, rounded to an odd number: slot s stands at s * GOLDEN mod 2^32.
GOLDEN = 2654435769
#: The sources of a point are looked up by cell of the unit interval.
CELLS = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, size), one row a source -> source, rank (by code point, null last), weight, size, target.

    Targets share the sum of sizes by weight, each at most `most` times its source's size; what is above is shared
    again by weight among the others. Sorted by size / weight, the sources that stop are a prefix: source i stops if
    its share of what is left for i and all later ones is at least its limit. Only one row a source is sorted.
    """
    kinds = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(kinds, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("most", F.col("size") * most)
    order, whole = Window.orderBy(F.col("size") / F.col("weight"), "rank"), Window.partitionBy(F.lit(0))
    rest = ranked.withColumn("left", F.sum("size").over(whole) - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rest = rest.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    rest = rest.withColumn("stops", F.min((F.col("left") * F.col("weight") >= F.col("most") * F.col("open")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    # "left / open" is the same for every open source in exact arithmetic; the first one's is meant.
    first = F.first(F.when(~F.col("stops"), F.col("left") / F.col("open")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rest.withColumn("share", first).select("source", "rank", "weight", "size", F.when(F.col("stops"), F.col("most").cast("double")).otherwise(F.col("share") * F.col("weight")).alias("target"))


def _goals(sizes: DataFrame, slots: int) -> DataFrame:
    """targets() with the block length, the number of blocks, the words to take and the slots that needs."""
    whole = Window.partitionBy(F.lit(0))
    goals = targets(sizes).withColumn("block_words", F.greatest(F.lit(1), F.ceil(F.sum("size").over(whole) / slots)).cast("long"))
    goals = goals.withColumn("take", F.least(F.round("target"), F.col("size") * MOST).cast("long")).withColumn("blocks", F.expr("(size + block_words - 1) div block_words"))
    upper = F.sum("target").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) / F.nullif(F.sum("target").over(whole), F.lit(0.0))
    goals = goals.withColumn("upper", F.round(F.coalesce(upper, F.lit(0.0)) * (1 << 32)).cast("long")).withColumn("lower", F.coalesce(F.lag("upper").over(Window.orderBy("rank")), F.lit(0)))
    return goals.withColumn("needs", F.expr("if(size = 0, 0, take div size * blocks + (take % size + block_words - 1) div block_words)"))


def schedule(goals: DataFrame) -> DataFrame:
    """_goals() -> (rank, slot, k, block, words): slot k of a source takes `words` words of that block.

    Slots beyond a source's need are dropped, its last one is cut to the target, and what the points left out comes
    after all other slots (slot null). Slots are counted by source and run, then over the runs of a source.
    """
    cell = (1 << 32) // CELLS
    points = (
        goals.groupBy().agg(F.sum("needs").alias("n")).where("n > 0")
        .select(F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})")).alias("run"), "n").repartition("run")
        .select("run", F.explode(F.expr(f"sequence(run * {RUN}, least(run * {RUN} + {RUN - 1}, n - 1))")).alias("slot"))
        .withColumn("point", F.expr(f"(slot * {GOLDEN}) & 4294967295")).withColumn("cell", F.expr(f"point div {cell}"))
    )
    touched = goals.where("upper > lower").select("rank", "lower", "upper", F.explode(F.expr(f"sequence(lower div {cell}, (upper - 1) div {cell})")).alias("cell"))
    hits = points.join(touched.hint("merge"), "cell").where("point >= lower and point < upper").select("rank", "run", "slot")
    per = hits.groupBy("rank", "run").agg(F.count(F.lit(1)).alias("c"))
    base = per.select("rank", "run", F.coalesce(F.sum("c").over(Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = hits.join(base.hint("merge"), ["rank", "run"]).select("rank", "slot", (F.col("base") + F.row_number().over(Window.partitionBy("rank", "run").orderBy("slot")) - 1).alias("k"))
    found = per.groupBy("rank").agg(F.sum("c").alias("found"))
    late = (
        goals.join(found.hint("merge"), "rank", "left").where("needs > coalesce(found, 0)")
        .select("rank", F.lit(None).cast("long").alias("slot"), F.explode(F.expr("sequence(coalesce(found, 0L), needs - 1)")).alias("k"))
    )
    kept = ranked.unionByName(late).join(goals.select("rank", "size", "block_words", "blocks", "take", "needs").hint("merge"), "rank").where("k < needs")
    kept = kept.withColumn("round", F.expr("k div blocks")).withColumn("block", F.expr("k % blocks"))
    return kept.select("rank", "slot", "k", "block", F.expr("least(block_words, size - block * block_words, take - round * size - block * block_words)").alias("words"))


def _laid_out(docs: DataFrame, seed: int) -> DataFrame:
    """docs(doc_id, rank, size, ...) with `start`, the first word's place in the source's stream of shuffled documents.

    A source's documents are split by hash into 4096 stretches; sums run over stretches, then within each, so that a
    source with a third of all rows is spread over many tasks.
    """
    hashed = docs.withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id"))).withColumn("stretch", F.shiftrightunsigned("h", 52).cast("int"))
    per = hashed.groupBy("rank", "stretch").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("rank").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("rank", "stretch", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("rank", "stretch").orderBy("h", "doc_id", "size", *(["row"] if "row" in docs.columns else [])).rowsBetween(Window.unboundedPreceding, -1)
    return hashed.join(base.hint("merge"), ["rank", "stretch"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))).drop("base", "h", "stretch")


def pieces(placed: DataFrame, goals: DataFrame) -> DataFrame:
    """The mix itself: placed rows with slot, round, from and words, one for each piece of a document that a slot takes.

    Sorted by slot, rank and start, it is the interleaved stream. What the points left out comes after all other slots,
    by its turn. A piece has `words` words from word `from` of its document on.
    """
    n = goals.agg(F.sum("needs")).first()[0] or 0
    slots = schedule(goals).withColumn("slot", F.coalesce("slot", F.col("k") + n)).withColumnRenamed("words", "whole")
    slots = slots.join(goals.select("rank", "blocks").hint("merge"), "rank").withColumn("round", F.expr("k div blocks")).drop("blocks", "k")
    parts = placed.withColumn("block", F.explode(F.expr("sequence(start div block_words, (start + size - 1) div block_words)")))
    low = F.expr("greatest(start, block * block_words)")
    high = F.expr("least(start + size, block * block_words + whole)")
    rows = parts.join(slots.hint("merge"), ["rank", "block"]).withColumn("from", low - F.col("start")).withColumn("words", high - low)
    return rows.where("words > 0").drop("whole", "block")


def _placed(docs: DataFrame, seed: int, slots: int, row: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row with its rank and source, those with words with their place in the stream, and the goals."""
    sized = cut(docs.select("doc_id", *([F.col(row).alias("row")] if row else []), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size")))
    goals = cut(_goals(sized.groupBy("source").agg(F.sum("size").alias("size")), slots))
    side = goals.select(F.col("source").alias("s"), "rank", F.col("size").alias("source_size"), "target", "block_words")
    ranked = sized.join(side.hint("merge"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return ranked, _laid_out(ranked.where("size > 0"), seed), goals


def stream(docs: DataFrame, seed: int = 7, slots: int = SLOTS) -> DataFrame:
    """(slot, source, place, doc_id, from, words): the interleaved mix, a row a piece, in order of slot and place."""
    _, placed, goals = _placed(docs, seed, slots, None)
    rows = pieces(placed, goals)
    rows = rows.repartitionByRange("slot", "rank", "start").sortWithinPartitions("slot", "rank", "start")
    return rows.select("slot", "source", F.col("start").alias("place"), "doc_id", "from", "words")


def mix(docs: DataFrame, seed: int = 7, slots: int = SLOTS, row: str | None = None) -> DataFrame:
    """doc_id, source, size (words), source_size, target, taken, slots, place for every row of docs(doc_id, source, text).

    `taken` counts the words of the pieces() of the document, repeats included: at most three times its size, and over
    a source its target to the nearest word. `slots` has the slot at which each of its copies starts, the last one
    perhaps cut, and `place` its first word's place in the source's stream. Null texts have size 0 and are never taken;
    a null source is a source of its own; rows that repeat a doc_id each have their own place in the stream. An empty
    table gives no rows; other columns are not read. Only ids, sources and sizes are shuffled, never texts. Joins are
    merge joins: a table of a few rows would take the driver 64 MB and more to broadcast, several times over. A column
    `row` that tells rows of one doc_id apart is handed on as `row`.
    """
    ranked, placed, goals = _placed(docs, seed, slots, row)
    placed = cut(placed)
    names = ["doc_id", *(["row"] if row else []), "source", "size", "source_size", "target"]
    own = ["rank", "start"]
    turns = pieces(placed, goals).groupBy(*own).agg(F.sum("words").alias("taken"), F.collect_list(F.when(F.col("from") == 0, F.struct("round", "slot"))).alias("turns"))
    slots_of = F.transform(F.array_sort("turns"), lambda x: x["slot"])
    taken = placed.join(turns.hint("merge"), own, "left").select(*names, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce(slots_of, F.array().cast("array<bigint>")).alias("slots"), F.col("start").alias("place"))
    none = [F.lit(0).cast("long").alias("taken"), F.array().cast("array<bigint>").alias("slots"), F.lit(None).cast("long").alias("place")]
    return taken.unionByName(ranked.where("size = 0").select(*names, *none))


def repeat(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix as rows of docs: a document comes once for each whole time it is taken and once for a part of it.

    Rows are in order of the slots at which they start, by partitions and within them, so sources are interleaved.

    The part is the document's first words with the blanks before them. Documents with no taken word go. doc_id has
    to be a key of docs; mix_rows() takes any rows.
    """
    return _repeated(docs, mixed.withColumn("row", F.lit(0)), F.lit(0)).select(*docs.columns)


def mix_rows(docs: DataFrame) -> DataFrame:
    """repeat(docs, mix(docs)) for rows that may share a doc_id or have none: told apart by id, source and text.

    Rows that are equal in all three are taken together, as the one whose other columns, as JSON, come first. A null is
    no value of its column, so rows that have theirs in different columns are different rows.
    """
    names = ("doc_id", "source", "text")
    row = F.xxhash64(*names, *[F.col(c).isNull() for c in names])
    plan = mix(docs.withColumn("_row", row), row="_row").groupBy("doc_id", "row").agg(
        F.max("size").alias("size"), F.sum("taken").alias("taken"), F.array_sort(F.flatten(F.collect_list("slots"))).alias("slots"), F.min("place").alias("place")
    )
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    first = Window.partitionBy("doc_id", "_key").orderBy(F.to_json(F.struct(*others)) if others else F.lit(""))
    single = docs.withColumn("_key", row).withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_key", "_nth")
    return _repeated(single, plan, row).select(*docs.columns)


def _repeated(docs: DataFrame, mixed: DataFrame, row: Column) -> DataFrame:
    """Rows of docs by the rows of mixed with the same doc_id and `row`."""
    plan = mixed.where("taken > 0").select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), F.col("size").alias("_size"), F.col("taken").alias("_taken"), F.col("slots").alias("_slots"), F.col("place").alias("_place"))
    times = F.expr("transform(sequence(1, cast((_taken + _size - 1) div _size as int)), i -> least(_size, _taken - (i - 1) * _size))")
    rows = docs.join(plan.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (row == F.col("_r"))).select("*", F.posexplode(times).alias("_turn", "_words"))
    rows = rows.withColumn("_slot", F.get("_slots", F.col("_turn"))).drop("_slots")
    rows = rows.repartitionByRange("_slot", "_place").sortWithinPartitions("_slot", "_place")
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    whole = F.col("_words") == F.col("_size")
    rows = rows.withColumn("text", F.when(whole, F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("_words").cast("int")), "")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return rows
