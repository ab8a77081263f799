"""Scalar functions over strings and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words that tags do not keep.
STOP_WORDS = [
    "a", "about", "after", "all", "also", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "do", "for", "from", "had", "has", "have",
    "he", "her", "his", "how", "i", "if", "in", "into", "is", "it", "its", "more", "no", "not", "of", "on", "or", "other", "our", "out", "she", "so",
    "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "up", "was", "we", "were", "what", "when",
    "which", "who", "will", "with", "would", "you", "your",
]


def tag_filter(text: Column) -> Column:
    """Lower-case ASCII words without stop words: other characters part words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(STOP_WORDS))


def multivalue(text: Column, separator: str = ",") -> Column:
    """Trimmed lower-case values of a field that holds several; empty ones go."""
    return F.filter(F.transform(F.split(text, separator), lambda v: F.trim(F.lower(v))), lambda v: v != "")


def prefixed(prefix: str, value: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), value.cast("string"))


def year_of(date: Column) -> Column:
    """The year of a date string; null if there is none."""
    return F.try_to_number(F.regexp_extract(F.split_part(date, F.lit("-"), F.lit(1)), r"^([0-9]{4})$", 1), F.lit("9999")).cast("int")


def overlapping(value: Column, size: int, step: int) -> Column:
    """value - size * step, ..., value, ..., value + size * step."""
    return F.sequence(value - size * step, value + size * step, F.lit(step))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalised(vector: Column) -> Column:
    norm = l2_norm(vector)
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def discount(rank: Column) -> Column:
    return 1 / F.log(rank + 1)


def gain(relevance: Column) -> Column:
    return F.pow(F.lit(2.0), relevance) - 1
