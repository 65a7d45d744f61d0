"""Text normalisation, comparison and labels as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode defines it, with the four separators of ASCII.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Noise patterns and the category each belongs to.
PATTERN_CATEGORY = {
    "language_prefix": "formatting",
    "verbose_preamble": "formatting",
    "translation_prefix": "formatting",
    "code_block": "formatting",
    "special_formatting": "formatting",
    "extra_punctuation": "formatting",
    "explanation": "content",
    "cultural_note": "content",
    "bilingual_output": "content",
    "alternatives": "content",
    "wrong_language": "content",
    "off_topic": "content",
    "none": "clean",
}


def strip(text: Column) -> Column:
    """Without white space at either end (every Unicode white space, not only U+0020). Null stays null."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def _compose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([None if t is None else unicodedata.normalize("NFC", t) for t in batch], dtype=object, index=batch.index)


def nfc(text: Column) -> Column:
    """Canonical composition. ASCII texts never leave the JVM."""
    _compose.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    other = text.rlike(r"[^\x00-\x7F]")
    return F.when(other, F.pandas_udf(_compose, "string")(F.when(other, text))).otherwise(text)


def normalize_text(text: Column) -> Column:
    """Stripped and composed; null becomes the empty string."""
    return nfc(strip(F.coalesce(text, F.lit(""))))


def is_exact_match(left: Column, right: Column) -> Column:
    """Equal after :func:`normalize_text`; null equals empty."""
    return normalize_text(left) == normalize_text(right)


def coverage(extracted: Column, original: Column) -> Column:
    """Stripped length of the extraction over that of the original; 1.0 where the original is null or blank."""
    whole = F.length(strip(F.coalesce(original, F.lit(""))))
    return F.when(whole == 0, F.lit(1.0)).otherwise(F.length(strip(F.coalesce(extracted, F.lit("")))) / whole)


def synthetic_label(extracted: Column, reference: Column) -> Column:
    """``struct(label, match, method)``: 1 if the extraction is the reference."""
    match = is_exact_match(extracted, reference)
    return F.struct(match.cast("int").alias("label"), match.alias("match"), F.lit("exact_match").alias("method"))


def curated_label(extracted: Column, original: Column, threshold: float = 0.8) -> Column:
    """1 where the coverage is above the threshold (strictly)."""
    return (coverage(extracted, original) > threshold).cast("int")


def detection_label(extracted: Column, original: Column) -> Column:
    """1 (clean) where the extraction leaves the original unchanged."""
    return is_exact_match(extracted, original).cast("int")


def noise_category(pattern: Column) -> Column:
    """Category of a noise pattern; null for null, empty and unknown patterns."""
    table = F.create_map(*[F.lit(x) for pair in PATTERN_CATEGORY.items() for x in pair])
    return F.try_element_at(table, F.coalesce(pattern, F.lit("")))


def gold_is_noisy(label: Column) -> Column:
    """Canonical polarity of a gold label that says 1 for clean: 1 for noisy; a missing label counts as noisy."""
    return F.coalesce(1 - label, F.lit(1))
