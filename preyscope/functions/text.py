"""String and list columns of protein tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def items(c: Column, sep: str = ";") -> Column:
    """A separated list as an array of trimmed, non-empty items."""
    return F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")


def short_ids(c: Column, most: int = 3) -> Column:
    """More than `most` items become the first ones and ;+N, with blanks as dashes; shorter lists stay as they are."""
    parts = F.split(c, ";")
    cut = F.concat(F.array_join(F.slice(parts, 1, most), ";"), F.lit(";+"), (F.size(parts) - most).cast("string"))
    return F.when(F.size(parts) > most, F.regexp_replace(cut, " ", "-")).otherwise(c)


def first_item(c: Column) -> Column:
    return F.split_part(c, F.lit(";"), F.lit(1))


def first_location(c: Column) -> Column:
    """The first subcellular location: after the heading, up to ; or { or ]: or , or . (null without one)."""
    body = F.regexp_replace(c, "^.*?SUBCELLULAR LOCATION: ", "")
    for stop in (";", r" \{", r"\]: ", ",", r"\."):
        body = F.split(body, stop, 2)[0]
    return F.when(F.trim(body) != "", F.trim(body))


def clean_go(c: Column) -> Column:
    """Ontology names without their [GO:...] ids, joined by '; '."""
    return F.array_join(F.filter(F.transform(F.split(F.regexp_replace(c, r"\s*\[[^\]]*\]", ""), ";"), lambda x: F.trim(x)), lambda x: x != ""), "; ")


def feature_notes(c: Column) -> Column:
    """All /note="..." values joined by '; '; null without any."""
    return F.nullif(F.array_join(F.regexp_extract_all(c, F.lit('/note="([^"]*)"'), F.lit(1)), "; "), F.lit(""))


def go_ids(c: Column) -> Column:
    """GO ids of `name [GO:0000000]; ...`, in order."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(r"\[(GO:\d+)\]"), F.lit(1)), F.array().cast("array<string>"))


def intensities(c: Column) -> Column:
    """A pipe list as doubles; '.', blanks and what is no number are dropped."""
    return F.coalesce(F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull()), F.array().cast("array<double>"))


def features(c: Column) -> Column:
    """A ; list as distinct features: trailing digits stripped, empty ones and those that begin with a digit dropped."""
    bare = F.transform(F.split(c, ";"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"\s*\d+$", "")))
    return F.array_distinct(F.filter(bare, lambda x: (x != "") & ~x.rlike("^[0-9]")))


def group_spec(c: Column) -> Column:
    """A group cell as struct(is_universal, groups, is_valid): null or blank (no group), '*', or positive numbers.

    '*' mixed with numbers, numbers below 1 and anything else is not valid; groups are distinct and sorted.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    blank = F.trim(F.coalesce(c, F.lit(""))) == ""
    star = F.array_contains(parts, "*")
    whole = F.forall(parts, lambda x: x.rlike(r"^0*[1-9][0-9]{0,8}$"))
    numbers = F.array_sort(F.array_distinct(F.transform(F.filter(parts, lambda x: x.rlike(r"^0*[1-9][0-9]{0,8}$")), lambda x: x.cast("int"))))
    valid = blank | (star & (F.size(parts) == 1)) | (~star & whole & (F.size(parts) > 0))
    return F.struct((star & (F.size(parts) == 1)).alias("is_universal"), F.when(star | ~valid, F.array().cast("array<int>")).otherwise(numbers).alias("groups"), valid.alias("is_valid"), star.alias("has_star"))
