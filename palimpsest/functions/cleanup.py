"""Formatting cleanup of model outputs: native expressions, one pass each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Labels that stand before a colon and are dropped with it.
PREFIXES = (
    "Chinese|Arabic|English|French|German|Russian|Hebrew|Czech|Polish|Tamil|Khmer|Korean|Italian|Spanish|Japanese|Portuguese|"
    "Turkish|Translation|Translated|Here is the translation"
)
_PREFIX = rf"(?iUd)\A(?:{PREFIXES})\s*:\s*"
_FENCE = "```"


def strip_code_block(text: Column) -> Column:
    """Without a fence around the whole text. A closing fence that shares its line with text stays; one line stays."""
    bare = strip(text)
    lines = F.split(bare, "\n", -1)
    size = F.size(lines)
    inner = F.when(strip(F.element_at(lines, -1)) == _FENCE, size - 2).otherwise(size - 1)
    body = strip(F.array_join(F.slice(lines, F.lit(2), inner), "\n"))
    return F.when(bare.startswith(_FENCE) & bare.endswith(_FENCE) & (size >= 2), body).otherwise(bare)


def strip_special_formatting(text: Column) -> Column:
    """Without ``[[ ]]`` or ``{{ }}`` around the whole text. Both marks may overlap in very short texts."""
    bare = strip(text)
    inner = strip(F.substring(bare, F.lit(3), F.greatest(F.length(bare) - 4, F.lit(0))))
    wrapped = (bare.startswith("[[") & bare.endswith("]]")) | (bare.startswith("{{") & bare.endswith("}}"))
    return F.when(wrapped, inner).otherwise(bare)


def strip_language_prefix(text: Column) -> Column:
    """Without a language name or translation label before a colon at the start; other texts are not even trimmed."""
    return F.when(text.rlike(_PREFIX), strip(F.regexp_replace(text, _PREFIX, ""))).otherwise(text)


def strip_extra_punctuation(text: Column) -> Column:
    """Three or more equal ``!`` or ``?`` at the end become one."""
    return F.regexp_replace(text, r"([!?])\1{2,}\n?\z", "$1")


def clean_formatting(text: Column) -> Column:
    """All cleanups once, in order, then stripped. Null stays null."""
    return strip(strip_extra_punctuation(strip_language_prefix(strip_special_formatting(strip_code_block(text)))))
