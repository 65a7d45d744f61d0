"""Problem 4: one canonical form for text that looks the same but differs in its characters.

The canonical form of a text is made in three layers:

* *stable form*: invisible characters dropped, every space character turned into U+0020, compatibility forms that only
  change width, ligature or presentation folded, canonical composition (NFC). It is still readable text.
* *skeleton*: the stable form with look-alike letters mapped to one prototype. It is only for comparison.

Normalisation is done where it is needed: a quick check finds the characters that can change (or that can interact with a
neighbour), a segment is such a character with the starter before it and the marks after it, only segments are
normalised, and the results are spliced into the unchanged text. Texts without any such character come back untouched, and
the JVM-side test ``may_change`` keeps them out of Python altogether.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Look-alike letters and the prototype each is compared as (Cyrillic and Greek against Latin).
LOOKALIKES = {
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ї": "ï", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ё": "ë", "ѐ": "è",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ї": "Ï", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ё": "Ë", "Ѐ": "È", "Ӏ": "I",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j", "ό": "ó",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l", "ո": "n", "օ": "o", "ս": "u", "հ": "h",
    "‐": "-", "‑": "-", "к": "k", "ĸ": "k",
}
# Tags of compatibility mappings that change only how a character is set, not what is read.
FOLDED_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<font>", "<compat>")
# Ranges of characters that take no room.
INVISIBLE_RANGES = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB),
)
INVISIBLE = "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in INVISIBLE_RANGES)
# Ranges of characters that normalisation never changes and that never combine with a neighbour.
STABLE_RANGES = (
    (0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA1, 0xA7), (0xA9, 0xA9), (0xAB, 0xAC), (0xAE, 0xAE), (0xB0, 0xB1), (0xB6, 0xB7),
    (0xBB, 0xBB), (0xBF, 0x131), (0x134, 0x13E), (0x141, 0x148), (0x14A, 0x17E), (0x400, 0x481), (0x60C, 0x60C), (0x61B, 0x61B),
    (0x61F, 0x63A), (0x641, 0x64A), (0x660, 0x669), (0x2012, 0x2016), (0x2018, 0x201F), (0x2190, 0x21FF), (0x3001, 0x3002),
    (0x300A, 0x3011), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
)

_INVISIBLE_RE = re.compile(f"[{INVISIBLE}]+")
#: Java pattern of texts the quick check can let pass.
STABLE_JAVA = "^[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in STABLE_RANGES) + "]*$"


def _folds(char: str) -> str | None:
    """What a character's compatibility mapping gives, if it belongs to the folded kinds. A letter of a mapping that
    stands for words or figures (fractions, superscripts, circled forms) is left as it is: it looks different."""
    mapping = unicodedata.decomposition(char)
    if not mapping.startswith(FOLDED_TAGS):
        return None
    if mapping.startswith("<compat>") and unicodedata.category(char) not in ("Ll", "Lu", "Lo", "Lt", "Po", "Zs", "Nl"):
        return None
    return unicodedata.normalize("NFKC", char)


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str], frozenset[str]]:
    """The single-character folds and the characters that can change or combine, both derived from the Unicode database."""
    fold: dict[int, str] = {}
    unstable: list[int] = []
    for code in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x12000), *range(0x1D000, 0x1F200), *range(0x2F800, 0x2FA20)):
        char = chr(code)
        category = unicodedata.category(char)
        if category == "Zs":
            fold[code] = " "
            unstable.append(code)
        elif (folded := _folds(char)) is not None:
            fold[code] = folded
            unstable.append(code)
        elif unicodedata.combining(char) or not unicodedata.is_normalized("NFC", char) or 0x1100 <= code <= 0x11FF:
            unstable.append(code)
        elif _INVISIBLE_RE.match(char):
            fold[code] = ""
            unstable.append(code)
    return fold, frozenset(map(chr, unstable))


def stable_form(text: str | None) -> str | None:
    """Readable canonical text. ``None`` stays ``None``; empty stays empty."""
    if text is None or text.isascii():
        return text
    fold, unstable = _tables()
    if unstable.isdisjoint(text):
        return text
    # a segment is a run of unstable characters with the character before it, a starter it may compose with
    body = "".join(map(re.escape, sorted(unstable.intersection(text))))
    out = re.sub(f"[^{body}]?[{body}]+", lambda m: unicodedata.normalize("NFC", m.group().translate(fold)), text)
    # removing invisible characters can bring a base and its mark, or conjoining jamo, together
    return out if unicodedata.is_normalized("NFC", out) else unicodedata.normalize("NFC", out)


_LOOKALIKE_TABLE = {ord(k): v for k, v in LOOKALIKES.items()}
_LOOKALIKE_SET = frozenset(LOOKALIKES)


def skeleton(text: str | None) -> str | None:
    """Comparison form: equal for texts that look the same (outer white space aside)."""
    if text is None:
        return None
    out = (stable_form(text) or "").strip()
    if out.isascii() or _LOOKALIKE_SET.isdisjoint(out):
        return out
    return unicodedata.normalize("NFC", out.translate(_LOOKALIKE_TABLE))


def _case_closed() -> dict[int, str]:
    """``LOOKALIKES`` for comparison without case: both cases of a letter have one prototype (в, м, н, т that of В, М, Н, Т).
    Where each case looks like another letter (Ν and ν like N and v, Υ and υ, Ӏ and ӏ) each keeps its own: one prototype
    would make different Latin letters equal."""
    out = {k.casefold(): v.casefold() for k, v in LOOKALIKES.items()} | {k: v.casefold() for k, v in LOOKALIKES.items()}
    return {ord(k): v for k, v in out.items()}


_CASELESS_TABLE = _case_closed()


def caseless(text: str) -> str:
    """Text with look-alikes mapped and case folded, in whatever case it is written. For comparison only; not composed."""
    return text.translate(_CASELESS_TABLE).casefold().translate(_CASELESS_TABLE)


def caseless_skeleton(text: str | None) -> str | None:
    """Comparison form where case does not count either. Not for what a reader sees: в is b here, as В is B."""
    if text is None or text.isascii():
        return None if text is None else text.casefold()
    return unicodedata.normalize("NFC", caseless(stable_form(text) or ""))


def may_change(column: Column) -> Column:
    """JVM-side quick check: false where the stable form is certainly the text itself."""
    return ~column.rlike(STABLE_JAVA)


def _each(function):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known: dict[str, str | None] = {}
            out = []
            for text in batch:
                if text is not None and text not in known:
                    known[text] = function(text)
                out.append(None if text is None else known[text])
            yield pd.Series(out, dtype=object, index=batch.index)

    return run


def stable_column(column: Column) -> Column:
    """Canonical text of a column; only rows that fail the quick check visit Python."""
    udf = F.pandas_udf(_each(stable_form), "string")
    return F.coalesce(udf(F.when(may_change(column), column)), column)


def normalise_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the named text columns in canonical form. Null stays null, blank stays as it is, other columns are
    untouched, and column names that clash with nothing inside are not needed: only the named columns are rewritten."""
    return df.withColumns({name: stable_column(F.col(f"`{name}`")) for name in columns})


def looks_same(left: Column, right: Column) -> Column:
    """True where two texts differ by code points and look the same, outer white space aside. Null on either side gives false.

    Pairs of ASCII texts are compared in the JVM, all others by their skeletons: no length tells readings apart, as a
    syllable may be three jamo and a ligature stand for 18 characters."""
    plain = ~(left.rlike(r"[^\x00-\x7F]") | right.rlike(r"[^\x00-\x7F]"))
    pair = F.when(~plain, F.struct(left.alias("a"), right.alias("b")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            known: dict[str, str | None] = {}

            def skel(text: str, known: dict[str, str | None] = known) -> str | None:
                if text not in known:
                    known[text] = skeleton(text)
                return known[text]

            yield pd.Series(
                [a is not None and b is not None and a != b and skel(a) == skel(b) for a, b in zip(batch["a"], batch["b"], strict=True)],
                dtype=bool,
                index=batch.index,
            )

    bare = lambda c: F.regexp_replace(c, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    return F.coalesce(F.when(plain, (left != right) & (bare(left) == bare(right))).otherwise(F.pandas_udf(run, "boolean")(pair)), F.lit(False))


def disguised_rows(df: DataFrame, key: str, text: str, reference: str, table: str) -> DataFrame:
    """Rows ``(tbl, rec_id)`` of ``df`` whose ``text`` differs from ``reference`` by code points while a reader sees the same.

    Nulls in either text give no row; repeated rows give one row; an empty table gives none."""
    left, right = F.col(f"`{text}`"), F.col(f"`{reference}`")
    near = df.select(F.col(f"`{key}`").cast("bigint").alias("rec_id"), left.alias("a"), right.alias("b")).where(
        F.col("a").isNotNull()
        & F.col("b").isNotNull()
        & (F.col("a") != F.col("b"))
    )
    return near.where(looks_same(F.col("a"), F.col("b"))).select(F.lit(table).alias("tbl"), "rec_id").distinct()
