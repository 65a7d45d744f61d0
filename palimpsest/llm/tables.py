"""Readers of the project's tables, with the readings of labels that several problems share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The languages of the data by code, English name and three-letter code.
LANGUAGES = {
    "en": ("english", "eng"), "fr": ("french", "fra"), "de": ("german", "deu"), "es": ("spanish", "spa"),
    "it": ("italian", "ita"), "pt": ("portuguese", "por"), "pl": ("polish", "pol"), "cs": ("czech", "ces"),
    "ru": ("russian", "rus"), "zh": ("chinese", "zho"), "ko": ("korean", "kor"), "ar": ("arabic", "ara"),
}
# Other names and codes of the same languages.
LANGUAGE_ALIASES = {"fre": "fr", "ger": "de", "cze": "cs", "chi": "zh", "mandarin": "zh", "castilian": "es", "brazilian": "pt"}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def language_names() -> dict[str, str]:
    names = dict(LANGUAGE_ALIASES)
    for code, (name, three) in LANGUAGES.items():
        names |= {code: code, name: code, three: code}
    return names


def label_language(label: Column) -> Column:
    """Two-letter code that a label names, or null. Case, spaces, region and two- or three-letter form do not matter."""
    plain = F.regexp_replace(F.lower(label), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    head = F.regexp_extract(plain, r"^(\p{L}+)", 1)
    table = F.create_map(*[F.lit(x) for pair in language_names().items() for x in pair])
    return F.try_element_at(table, F.coalesce(head, F.lit("")))


def target_of_pair(lp: Column) -> Column:
    """Second language of a pair such as ``en-de``; null if the value is no pair."""
    code = F.regexp_extract(F.lower(F.coalesce(lp, F.lit(""))), r"^\s*\p{L}+\s*[-_]\s*(\p{L}+)\s*$", 1)
    return F.when(code != "", code)


def plain_source(source: Column) -> Column:
    """A source's plain spelling: trimmed, lower case, ``_`` and inner spaces as ``-``. Null and blank stay null."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(source), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"[\s_]+", "-")
    return F.when(plain != "", plain)
