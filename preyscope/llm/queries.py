"""The registered queries of the text operators: production parameters, whole tables, whole results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversation_trie, edit_embedding, langid, licenses, mixing, pii, quality, sentencepiece_codec, simhash, substrings, suffixes, whitening
from .common import documents


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    order = [rule for rule, _, _ in quality.rank_rules(docs)]
    out = quality.cascade(docs.select("doc_id", "text"), order)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", F.col("rejected_by").isNull().alias("kept"),
    )


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_duplicates(documents(spark, sf_dir))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_duplicates(documents(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_codec.encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), ids_column=None)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.compare_with_next(documents(spark, sf_dir), classes=True)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), ids_column=None)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_licenses, op3_pii, op4_quality, op5_langid, op6_substrings, op7_suffixes, op8_sentencepiece, op9_mixing, op10_fingerprints, op11_byte_bpe, op12_conversation_trie, op13_whitening)
}

_WORD = r"[^\x20\x09-\x0D]"
#: A step of CRC-32: a byte's eight shifts.
_CRC = "xor(a, b)"
for _ in range(8):
    _CRC = f"list_transform([{_CRC}], lambda v{_}: xor(v{_} >> 1, 3988292384 * (v{_} & 1)))[1]"
#: SQL for whole results; the other operators hash with functions that the oracle lacks, or are trained models.
ORACLE: dict[str, str] = {
    "op4_quality": rf"""
with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) l,
  row_number() over () r from documents),
u as (select r, unnest(w) x, generate_subscripts(w, 1) i from d),
v as (select r, i, x a, lead(x) over p b, lead(x, 2) over p c from u window p as (partition by r order by i)),
g as (select r, unnest([i, i + 1, i + 2]) i from (select *, count(*) over (partition by r, a, b, c) n from v where c is not null) where n > 1),
n as (select r, count(distinct i) n_repeat_words from g group by 1),
k as (select r, count(*) pairs, count(distinct (a, b)) different from v where b is not null group by 1),
m as (select doc_id, t, l, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols,
  len(l) - len(list_distinct(l)) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words, coalesce(pairs, 0) pairs, coalesce(different, 0) different from d left join n using (r) left join k using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or 10 * n_symbols > 3 * n_words or word_chars < 2 * n_words or word_chars > 15 * n_words
  or 2 * n_dup_lines > len(l) or 10 * length(regexp_replace(t, '[^\p{{L}}\p{{M}}]+', '', 'g')) < 7 * word_chars or (pairs > 0 and 10 * different < 3 * pairs)
  or (len(l) >= 5 and 10 * len(list_filter(l, lambda x: len(regexp_extract_all(x, '{_WORD}+')) < 3)) > 8 * len(l))) kept from b""",
    "op6_substrings": rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}+') w, row_number() over (order by doc_id nulls first, text) r from documents),
u as (select r, unnest(w) x, generate_subscripts(w, 1) i from d),
k as (select r, i, x, list(x) over (partition by r order by i rows between current row and 19 following) k from u),
f as (select r, i, x, len(k) = 20 and row_number() over (partition by k order by r, i) > 1 again from k),
c as (select r, i, x, bool_or(again) over (partition by r order by i rows between 19 preceding and current row) gone from f),
o as (select r, count(*) filter (gone) n_removed, coalesce(string_agg(x, ' ' order by i) filter (not gone), '') kept from c group by 1)
select doc_id, len(w) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join o using (r)""",
    "op7_suffixes": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h, row_number() over (order by doc_id nulls first, text) r from documents),
b as (select r, b, len(h) // 2 n, substr(h, 1000 * b + 1, 1198) h from (select *, unnest(range(0, (len(h) + 999) // 1000)) b from d)),
k as (select r, 500 * b i0, h, unnest(range(1, least(500, n - 500 * b) + 1)) i from b),
w as (select r, i0 + i i, substr(h, 2 * i - 1, 2) x, substr(h, 2 * i - 1, 200) k from k),
f as (select r, i, x, len(k) = 200 and row_number() over (partition by k order by r, i) > 1 again from w),
c as (select r, i, x, bool_or(again) over (partition by r order by i rows between 99 preceding and current row) gone from f),
e as (select *, gone and not coalesce(lag(gone) over (partition by r order by i), false) edge from c),
o as (select r, count(*) filter (gone) n_removed, count(*) filter (edge) n_spans, string_agg(x, '' order by i) filter (not gone) kept from e group by 1)
select doc_id, len(h) // 2 n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept, ''))) kept_sha256 from d left join o using (r)""",
    "op12_conversation_trie": rf"""
with t as (select conv_id c, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first, role, text) p from conversations where conv_id is not null),
i as (select distinct c, c::varchar s from t),
h as (select c, (xor(list_reduce(list_transform(range(1, length(s) + 1), lambda k: ascii(substr(s, k, 1))::bigint), lambda a, b: {_CRC}, 4294967295::bigint), 4294967295::bigint)) % 4 h from i),
b as (select h.c, 0 part, p, r, x from h join t on t.c = h.c - h.c % 20 where p <= h union all select h.c, 1, p, r, x from h join t using (c) where p > h),
m as (select c, md5(length(r) || ':' || r || x) k, len(regexp_extract_all(x, '{_WORD}+')) w, row_number() over (partition by c order by part, p) d from b),
k as (select c, d, w, string_agg(k, '') over (partition by c order by d) k from m union all select c, 0, 0, '' from i),
e as (select c, max_by(k, d) k from k group by 1),
f as (select k, sha256(string_agg(c::varchar, ',' order by c)) ends from e group by 1),
n as (select k, d, min(c) c, count(*) n, any_value(w) w from k group by 1, 2),
q as (select substr(k, 1, 32 * (d - 1)::integer) k, count(*) kids from n where d > 0 group by 1),
l as (select n.*, coalesce(kids, 0) kids from n left join q using (k)),
u as (select k, d, kids, n, w, unnest(range(0, d + 1)) a from l),
z as (select substr(k, 1, 32 * a::integer) k, count(*) filter (kids = 0) leaves, sum((n - 1) * w)::bigint saved from u group by 1)
select l.c conv_id, l.d depth, o.c parent_conv_id, l.n n_convs, l.kids n_children, leaves n_leaves, saved saved_tokens, coalesce(ends, sha256('')) ends_sha256
from l join z using (k) left join f using (k) left join n o on l.d > 0 and o.d = l.d - 1 and o.k = substr(l.k, 1, 32 * (l.d - 1)::integer)""",
}
