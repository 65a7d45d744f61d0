"""Does a translation hold more than the translation? Rules as native predicates, cheap ones first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Patterns of added text, searched without regard to case, line by line.
EXPLANATION_PATTERNS = (
    r"\b(the translation is|here is|here's|this translates to|translation:|translated text:|output:|target:)\b",
    r"\b(in \w+ (this|it) (means|says|translates))\b",
    r"\b(note that|please note|it should be noted)\b",
    r"\b(explanation|reasoning|analysis|breakdown)\b",
    r"\b(literally|figuratively|idiomatically|contextually)\b",
    r"\b(this (word|phrase|sentence|text))\b",
    r"\b(means|refers to|indicates|suggests)\b.*\b(that|which)\b",
    r"\b(hope this helps|let me know|feel free|if you|you can)\b",
    r"\b(please|kindly|note:|important:)\b",
    r"<think>|</think>|<thought>|</thought>",
    r"\*\*reasoning\*\*|\*\*analysis\*\*|\*\*explanation\*\*",
    r"\n\s*(translation|explanation|note|original|source|target)\s*:",
    r"^#+\s+",
    r"^\s*[\d\-\*]+[\.\)]\s+",
    r"\([^)]{50,}\)",
    r"<[a-zA-Z]+>.*</[a-zA-Z]+>",
)
#: Case-insensitive, multi-line, Unix lines, Unicode classes: what the rules mean by words, lines and digits.
_FLAGS = "(?imdU)"
PARAGRAPHS, NEWLINES, QUOTED, LABEL_WORDS, LENGTH_RATIO, LONG_REFERENCE = 2, 5, 100, 3, 2, 50


def label_colon(text: Column) -> Column:
    """A line with a colon and at most three words before the first one."""
    lines = F.split(text, "\n", -1)

    def labelled(line: Column) -> Column:
        head = F.regexp_replace(strip(F.substring_index(line, ":", 1)), r"(?U)[\s\x1c-\x1f]+", " ")
        words = F.when(head == "", F.lit(0)).otherwise(F.size(F.split(head, " ")))
        return line.contains(":") & (words <= LABEL_WORDS)

    return F.exists(lines, labelled)


def explained(text: Column, reference_length: Column | None = None) -> Column:
    """:func:`contains_explanation` of a stripped text that is not null."""
    paragraphs = F.size(F.filter(F.split(text, "\n\n", -1), lambda p: strip(p) != ""))
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    quote = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    starts = text.startswith('"') | text.startswith("'")
    ends = text.endswith('"') | text.endswith("'")
    quoted = starts & ends & (F.length(text) > QUOTED) & ((quote('"') > 2) | (quote("'") > 2))
    rule = (text == "") | (newlines > NEWLINES) | (paragraphs > PARAGRAPHS) | quoted | label_colon(text)
    if reference_length is not None:
        rule = rule | ((reference_length > LONG_REFERENCE) & (F.length(text) > LENGTH_RATIO * reference_length))
    for pattern in EXPLANATION_PATTERNS:
        rule = rule | text.rlike(_FLAGS + pattern)
    return rule


def contains_explanation(translation: Column, reference: Column | None = None) -> Column:
    """True for blank and null texts and for texts with an explanation, several sections, quotes around quotes, a label, or
    more than twice the length of a long reference."""
    known = None if reference is None else F.length(strip(F.coalesce(reference, F.lit(""))))
    return explained(strip(F.coalesce(translation, F.lit(""))), known)
