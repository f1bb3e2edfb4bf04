"""Personal data: pattern spans, and the terms near them that give them away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Terms are words of three letters or more outside of
e-mail addresses. A term is seen with an entity where it is among the NEAR words or mentions on either side. With c
documents in which they are seen together, df(t) documents with the term, df(e) with the entity and N in all, the term
reveals ln(c N / (df(t) df(e))) of the -ln(df(e) / N) nats that it takes to name the entity: the pointwise mutual
information as a share. A pair counts only if it is seen in SUPPORT different contexts, so that copies of one passage
are no evidence; an entity with fewer contexts discloses no term. In a document that holds the entity, every occurrence
of a term that reveals more than one share is replaced by its general class, above a second share it is removed.

Everything within a row is linear in the text but for two things: running sums over m matches cost m^1.5 small steps,
and words are looked up one by one among the row's own telling terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

# The contract's patterns, with possessive repetition and a start that does not depend on it; both leave
# what is matched as it is and keep long runs of one class linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{3,}+"
#: Words or mentions on either side of an entity among which terms are looked for.
NEAR = 6
#: Distinct contexts that a pair of entity and term needs.
SUPPORT = 3
#: Shares of an entity's information from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.6, 0.85
#: Tables of telling terms are broadcast up to about so many bytes; beyond, both sides are shuffled.
BROADCAST_BYTES = 8 << 20
#: Running sums are taken within blocks of so many, then over the blocks.
BLOCK = 32


def _pieces(text: Column, pattern: str) -> Column:
    """The text as structs (v, g): each match after the gap before it, and the last gap with a null match."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"), F.split(text, pattern).alias("g"))


def _running(steps: Column) -> Column:
    """Running sums of an array of whole numbers."""
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)

    def blocks(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))
        return let(parts, lambda p: let(F.transform(p, total), lambda t: F.flatten(F.transform(p, lambda y, b: within(y, total(F.slice(t, F.lit(1), b)))))))

    def within(y: Column, base: Column) -> Column:
        return let(base, lambda before: F.transform(y, lambda _, i: before + total(F.slice(y, F.lit(1), i + 1))))

    return let(steps, lambda x: F.when(F.size(x) == 0, x).otherwise(blocks(x)))


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as struct(s, e, v): code points, end exclusive, and the matched string."""

    def placed(pairs: Column) -> Column:
        ends = _running(F.transform(pairs, lambda x: F.char_length(x["g"]) + F.char_length(x["v"])))
        own = F.arrays_zip(F.transform(pairs, lambda x: x["v"]).alias("v"), ends.alias("e"))
        return F.transform(own, lambda x: F.struct((x["e"] - F.char_length(x["v"])).alias("s"), x["e"].alias("e"), x["v"].alias("v")))

    return let(F.filter(_pieces(text, pattern), lambda x: x["v"].isNotNull()), placed)


def _digits(value: Column) -> Column:
    return F.translate(value, " -+().", "")


def _luhn(value: Column) -> Column:
    n = F.char_length(value)
    digit = lambda i: F.substring(value, n - i, F.lit(1)).cast("int")
    worth = lambda i: F.when(i % 2 == 0, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    part = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    return {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["v"].rlike(rf"^{part}(?:\.{part}){{3}}$"),
        "card": lambda x: let(_digits(x["v"]), lambda d: F.char_length(d).between(16, 19) & _luhn(d)),
        "phone": lambda x: F.char_length(_digits(x["v"])).between(8, 15),
    }[kind]


#: A text without any of these has no match of the kind.
MARKS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}


def base_spans(text: Column) -> Column:
    """struct of kind -> valid spans struct(s, e, v) of a text that is not null."""
    empty = F.array().cast("array<struct<s:int,e:int,v:string>>")
    return F.struct(*[F.when(text.rlike(MARKS[k]), F.filter(_matches(text, p), _valid(k))).otherwise(empty).alias(k) for k, p in PATTERNS.items()])


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))


def _spanned(docs: DataFrame) -> DataFrame:
    """docs with `key` (of text and id) and `base`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("text", text).withColumn("base", base_spans(F.col("text"))).withColumn("key", F.xxhash64("doc_id", "text"))


def _terms(text: Column) -> Column:
    """Terms as struct(s, e, v): words of the text in which e-mail addresses are blanked, place for place."""
    blank = F.transform(_pieces(text, PATTERNS["email"]), lambda x: F.concat(x["g"], F.repeat(F.lit(" "), F.coalesce(F.char_length(x["v"]), F.lit(0)))))
    return let(F.when(text.contains("@"), F.array_join(blank, "")).otherwise(text), lambda t: _matches(t, TERM))


def _mentions() -> Column:
    """For each mention in a row, (entity, context, near): its terms and their hash in order, of the words by it."""
    element = lambda s, e, entity, term: F.struct(s.alias("s"), e.alias("e"), entity.alias("entity"), term.alias("term"))
    none = F.lit(None).cast("string")
    found = [F.transform(f"base.{k}", lambda x, k=k: element(x["s"], x["e"], F.concat(F.lit(f"{k}:"), F.lower(x["v"])), none)) for k in PATTERNS]
    words = F.transform(_terms(F.col("text")), lambda x: element(x["s"], x["e"], none, F.lower(x["v"])))

    def around(all_: Column, i: Column) -> Column:
        first = F.greatest(F.lit(1), i + 1 - NEAR)
        near = F.filter(F.slice(all_, first, i + NEAR + 2 - first), lambda y: y["term"].isNotNull())
        return F.transform(near, lambda y: y["term"])

    def each(all_: Column) -> Column:
        here = lambda x, i: F.when(x["entity"].isNotNull(), let(around(all_, i), lambda near: F.struct(x["entity"].alias("entity"), F.xxhash64(near).alias("context"), F.array_distinct(near).alias("near"))))
        return F.filter(F.transform(all_, here), lambda x: x.isNotNull())

    return let(F.sort_array(F.flatten(F.array(*found, words))), each)


def _words(docs: DataFrame, *keep: Column) -> DataFrame:
    """(keep..., term): a row for each different term of each row's text."""
    return docs.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(TERM), F.lit(0)))).alias("term"))


def telling_terms(spanned: DataFrame, docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(key, told): for rows that hold an entity with telling terms, these as a map from term to share.

    Only mentions with their neighbours and word counts are shuffled, never texts. Rows and entities meet by the entity
    or, where the term is the rarer of the two, by the term, so a common entity is not spread over all its rows.
    """
    some = spanned.where(" or ".join(f"size(base.{k}) > 0" for k in PATTERNS))
    seen = cut(some.select("key", F.explode(_mentions()).alias("m")).select("key", "m.*"))
    holders = seen.select("key", "entity").distinct()
    entity = holders.groupBy("entity").agg(F.count(F.lit(1)).alias("df_e"))
    near = seen.select("key", "entity", "context", F.explode("near").alias("term"))
    several = near.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts")).where(f"contexts >= {support}")
    together = near.select("entity", "term", "key").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("c"))
    frequency = _words(docs).groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    n = docs.count()
    told = several.join(together, ["entity", "term"]).join(entity, "entity").join(frequency, "term").where(F.col("df_e") < n)
    share = F.least(F.lit(1.0), F.log(F.col("c") * n / (F.greatest("df_t", "c") * F.col("df_e"))) / F.nullif(F.log(n / F.col("df_e")), F.lit(0.0)))
    telling = cut(told.withColumn("share", share).where(F.col("share") >= generalise).select("entity", "term", "share", (F.col("df_t") < F.col("df_e")).alias("rare")))
    marks = holders.join(telling.where("not rare"), "entity").select("key", "term", "share")
    rare = telling.where("rare").select("entity", "term", "share")
    if not rare.isEmpty():
        rare = _sized(rare, F.octet_length("entity") + F.octet_length("term") + 64)
        held = _words(some, F.col("key")).join(rare, "term").join(holders, ["key", "entity"])
        marks = marks.unionByName(held.select("key", "term", "share"))
    best = marks.groupBy("key", "term").agg(F.max("share").alias("share"))
    return best.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("told"))


def _sized(df: DataFrame, row_bytes: Column) -> DataFrame:
    """df, marked to be broadcast if its rows have BROADCAST_BYTES at most."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES else df


def _with_terms(docs: DataFrame) -> DataFrame:
    """_spanned(docs) with `told` (null: none)."""
    spanned = _spanned(docs)
    told = cut(telling_terms(spanned, docs).withColumnRenamed("key", "k"))
    told = _sized(told, F.lit(64) + F.aggregate(F.map_keys("told"), F.lit(0), lambda a, x: a + F.octet_length(x) + 40))
    return spanned.join(told, F.col("key") == F.col("k"), "left").drop("k", "key")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs(doc_id, text).

    spans lists kind:start:end of the pattern spans, then of the telling terms (kind `term`), all by start. Null texts
    count as empty; rows that repeat an id and text get the same result each; of equal shares all terms count; texts may
    be of any length; other columns are not read.
    """
    rows = _with_terms(docs.select("doc_id", "text"))
    base = F.flatten(F.array(*[_joined(k, F.col(f"base.{k}")) for k in PATTERNS]))
    terms = F.filter(_terms(F.col("text")), lambda x: F.map_contains_key("told", F.lower(x["v"])))
    spans = F.when(F.col("told").isNull(), base).otherwise(F.concat(base, _joined("term", terms)))
    return rows.select(
        "doc_id", *[F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(spans, ",").alias("spans"),
    )


def _replaced(text: Column, kind: str) -> Column:
    """The text with the kind's valid matches replaced by <KIND>."""
    put = lambda x: F.concat(x["g"], F.when(x["v"].isNull(), "").when(_valid(kind)(x), f"<{kind.upper()}>").otherwise(x["v"]))
    return let(text, lambda t: F.when(t.rlike(MARKS[kind]), F.array_join(F.transform(_pieces(t, PATTERNS[kind]), put), "")).otherwise(t))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with texts in which e-mail addresses become <EMAIL>; then, in what is left between them, telling terms
    <TERM> (generalised) or nothing (removed), and phone and card numbers and IP addresses, in this order, <PHONE>,
    <CARD> and <IP>. Null texts stay null; n_chars follows if there is such a column.
    """
    rows = _with_terms(docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("row")))

    def word(x: Column) -> Column:
        return F.concat(x["g"], F.when(x["v"].isNull(), "").otherwise(let(F.element_at("told", F.lower(x["v"])), lambda share: F.when(share >= REMOVE, "").when(share.isNotNull(), "<TERM>").otherwise(x["v"]))))

    def plain(gap: Column) -> Column:
        without = F.when(F.col("told").isNull(), gap).otherwise(F.array_join(F.transform(_pieces(gap, TERM), word), ""))
        return _replaced(_replaced(_replaced(without, "phone"), "card"), "ip")

    parts = F.transform(_pieces(F.col("text"), PATTERNS["email"]), lambda x: F.concat(plain(x["g"]), F.when(x["v"].isNull(), "").otherwise("<EMAIL>")))
    same = F.col("told").isNull() & ~F.exists(F.array(*[F.size(f"base.{k}") > 0 for k in PATTERNS]), lambda x: x)
    rows = rows.withColumn("clean", F.when(F.col("row.text").isNull(), F.lit(None).cast("string")).when(same, F.col("text")).otherwise(F.array_join(parts, "")))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.char_length("clean").cast(docs.schema["n_chars"].dataType), F.col("row.n_chars"))
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
