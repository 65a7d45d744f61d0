"""Scripts of a text and the language check built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE_SPACE, strip

# Code-point ranges of the scripts, in the order they are tried.
SCRIPT_RANGES = {
    "ARABIC": r"\x{600}-\x{6FF}",
    "HEBREW": r"\x{590}-\x{5FF}",
    "CYRILLIC": r"\x{400}-\x{4FF}",
    "HAN": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}",
    "HANGUL": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}",
    "TAMIL": r"\x{B80}-\x{BFF}",
    "KHMER": r"\x{1780}-\x{17FF}",
    "LATIN": r"\x{0}-\x{24F}",
    "DEVANAGARI": r"\x{900}-\x{97F}",
    "THAI": r"\x{E00}-\x{E7F}",
}
# Scripts a language may be written in; other languages are not checked.
LANGUAGE_SCRIPTS = {
    "en": ("LATIN",), "fr": ("LATIN",), "it": ("LATIN",), "de": ("LATIN",), "cs": ("LATIN",), "pl": ("LATIN",), "ru": ("CYRILLIC",),
    "ar": ("ARABIC",), "zh": ("HAN", "CJK"), "ko": ("HANGUL", "HAN", "CJK"), "ta": ("TAMIL",), "he": ("HEBREW",), "km": ("KHMER",),
}
LEAST_SHARE, EXPECTED_SHARE, MOST_SCRIPTS, SHORT = 0.03, 0.6, 2, 10
#: With a language model: least confidence for short and long texts, the length that parts them, and the floor of doubt.
SURE_SHORT, SURE_LONG, SHORT_FOR_MODEL, DOUBT, SHARE_IN_DOUBT = 0.7, 0.5, 20, 0.3, 0.05


def _count(text: Column, name: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SCRIPT_RANGES[name]}]+", ""))  # runs, not single characters


def all_shares(bare: Column) -> Column:
    """``map<script, share>`` of the scripts of a text without white space. Characters of no known script count in the whole only."""
    whole = F.length(bare)
    entries = [F.struct(F.lit(name).alias("k"), F.when(whole > 0, _count(bare, name) / whole).otherwise(0.0).alias("v")) for name in SCRIPT_RANGES]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"] > 0))


def script_shares(text: Column, least: float = LEAST_SHARE) -> Column:
    """``map<script, share>`` of the characters that are no white space; shares below ``least`` are left out. Empty and null texts
    have an empty map."""
    return F.map_filter(all_shares(bare_text(text)), lambda _, v: v >= least)


def character_script(char: Column) -> Column:
    """Script of one character: the first range that holds it, ``COMMON`` for marks, symbols and digits outside all ranges,
    else ``UNKNOWN``."""
    out = None
    for name, ranges in SCRIPT_RANGES.items():
        test = char.rlike(f"^[{ranges}]$")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.when(char.rlike(r"^[\p{P}\p{S}\p{N}]$"), "COMMON").otherwise("UNKNOWN")


def _expected(language: Column) -> Column:
    table = F.create_map(*[x for code, names in LANGUAGE_SCRIPTS.items() for x in (F.lit(code), F.array(*map(F.lit, names)))])
    return F.try_element_at(table, language)


def _share_of(shares: Column, names: Column) -> Column:
    return F.aggregate(F.transform(names, lambda n: F.coalesce(F.try_element_at(shares, n), F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)


def bare_text(text: Column) -> Column:
    """The characters that are no white space; null has none."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def language_verdict(text: Column, language: Column, shares: Column, detected: Column | None = None, confidence: Column | None = None) -> Column:
    """:func:`is_correct_language` with the text's ``shares`` (of any size, see :func:`all_shares`) at hand."""
    large = lambda least: F.map_filter(shares, lambda _, v: v >= least)
    names = F.map_keys(large(LEAST_SHARE))
    wanted = _expected(language)
    by_script = (
        F.when(wanted.isNull(), True)
        .when(F.size(names) == 0, F.length(strip(text)) < SHORT)
        .when(_share_of(large(LEAST_SHARE), wanted) < EXPECTED_SHARE, False)
        .otherwise(F.size(names) <= MOST_SCRIPTS)
    )
    verdict = by_script
    if detected is not None and confidence is not None:
        sure = F.when(F.length(strip(text)) < SHORT_FOR_MODEL, SURE_SHORT).otherwise(SURE_LONG)
        in_doubt = F.when(wanted.isNotNull() & (_share_of(large(SHARE_IN_DOUBT), wanted) >= EXPECTED_SHARE), True).otherwise(detected == language)
        verdict = F.when(detected.isNotNull() & (confidence >= sure), detected == language).when(detected.isNotNull() & (confidence >= DOUBT), in_doubt).otherwise(by_script)
    empty = text.isNull() | (text == "") | language.isNull() | (language == "")
    return F.when(empty, False).otherwise(verdict)


def is_correct_language(text: Column, language: Column, detected: Column | None = None, confidence: Column | None = None) -> Column:
    """Is the text written in the language? Null and empty text or language: false.

    ``detected`` and ``confidence`` are a language model's answer, if there is one; without it, or below the floor of its
    confidence, scripts decide: unknown languages pass, a text without any script passes if it is short, the expected scripts
    need most of the text, and more than two scripts fail."""
    return language_verdict(text, language, all_shares(bare_text(text)), detected, confidence)
