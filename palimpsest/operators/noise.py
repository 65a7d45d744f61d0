"""Noise put on clean translations: rule-based wrappers as columns, weighted draws by hash, and requests for the rest.

A draw is a bucket of a hash of a key, so it is the same wherever and whenever the row is computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import language_name

# Weights of the noise patterns in hundredths, in the order of the draw.
FORMATTING_WEIGHTS = {"language_prefix": 7, "verbose_preamble": 9, "translation_prefix": 1, "code_block": 3, "special_formatting": 2, "extra_punctuation": 3}
CONTENT_WEIGHTS = {"explanation": 33, "cultural_note": 1, "bilingual_output": 7, "alternatives": 15, "wrong_language": 7, "off_topic": 12}
COMBO_WEIGHTS = {"language_prefix": 28, "verbose_preamble": 9, "translation_prefix": 3}
ALL_WEIGHTS = {
    "explanation": 33, "alternatives": 15, "off_topic": 12, "verbose_preamble": 9, "bilingual_output": 7, "wrong_language": 7,
    "language_prefix": 7, "extra_punctuation": 3, "code_block": 3, "special_formatting": 2, "translation_prefix": 1, "cultural_note": 1,
}
UNKNOWN_WEIGHT = 5
RULES = tuple(FORMATTING_WEIGHTS)
FAILED_PATTERN = "verbose_preamble_fallback"
COMBO_CATEGORY = "content+formatting"


def draw(key: Column, sides: int) -> Column:
    """A number below ``sides`` from the first 32 bits of the key's MD5 (portable to any SQL engine)."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(sides))


def weighted(key: Column, weights: dict[str, int]) -> Column:
    """A name drawn by its weight."""
    drawn, below, out = draw(key, sum(weights.values())), 0, None
    for name, weight in weights.items():
        below += weight
        out = F.when(drawn < below, name) if out is None else out.when(drawn < below, name)
    return out


def pick_pattern(key: Column, allowed: list[str]) -> Column:
    return weighted(key, {p: ALL_WEIGHTS.get(p, UNKNOWN_WEIGHT) for p in allowed})


def _one_of(key: Column, choices: list[Column]) -> Column:
    drawn, out = draw(key, len(choices)), None
    for number, choice in enumerate(choices[:-1]):
        out = F.when(drawn == number, choice) if out is None else out.when(drawn == number, choice)
    return choices[-1] if out is None else out.otherwise(choices[-1])


# The wordings of the rules below.
def language_prefix(text: Column, src_lang: Column, tgt_lang: Column, source: Column, key: Column) -> Column:
    return F.concat(language_name(tgt_lang), F.lit(": "), text)


def verbose_preamble(text: Column, src_lang: Column, tgt_lang: Column, source: Column, key: Column) -> Column:
    a, b, gap = language_name(src_lang), language_name(tgt_lang), F.lit(":\n\n")
    return _one_of(
        key,
        [
            F.concat(F.lit('Here is the translation of "'), source, F.lit('" from '), a, F.lit(" to "), b, gap, text),
            F.concat(F.lit("Here is the "), b, F.lit(" translation"), gap, text),
            F.concat(F.lit("Translation from "), a, F.lit(" to "), b, gap, text),
            F.concat(F.lit("The "), b, F.lit(" translation of the above is"), gap, text),
        ],
    )


def translation_prefix(text: Column, src_lang: Column, tgt_lang: Column, source: Column, key: Column) -> Column:
    """The last two labels bring a space of their own, so two stand before the text."""
    return _one_of(key, [F.concat(F.lit(label), F.lit(" "), text) for label in ("Translation:", "Translated:", "Translation: ", "Here is the translation: ")])


def code_block(text: Column, src_lang: Column, tgt_lang: Column, source: Column, key: Column) -> Column:
    return F.concat(F.lit("```\n"), text, F.lit("\n```"))


def special_formatting(text: Column, src_lang: Column, tgt_lang: Column, source: Column, key: Column) -> Column:
    """Double square brackets, or single braces."""
    return _one_of(key, [F.concat(F.lit("[["), text, F.lit("]]")), F.concat(F.lit("{"), text, F.lit("}"))])


def extra_punctuation(text: Column, src_lang: Column, tgt_lang: Column, source: Column, key: Column) -> Column:
    more = lambda *marks: _one_of(key, [F.concat(text, F.lit(m)) for m in marks])
    return F.when(text.endswith("!"), more("!", "!!", "!!!")).when(text.endswith("?"), more("?", "??")).otherwise(more("!!", "??"))


_FUNCTIONS = {"language_prefix": language_prefix, "verbose_preamble": verbose_preamble, "translation_prefix": translation_prefix, "code_block": code_block, "special_formatting": special_formatting, "extra_punctuation": extra_punctuation}


def apply_rule(pattern: Column, text: Column, src_lang: Column, tgt_lang: Column, source: Column, key: Column) -> Column:
    """The text with the rule-based noise of ``pattern``; null for a pattern without rule. ``verbose_preamble`` has a rule
    and is never asked of a model."""
    out = None
    for name, function in _FUNCTIONS.items():
        made = function(text, F.coalesce(src_lang, F.lit("en")), F.coalesce(tgt_lang, F.lit("zh")), F.coalesce(source, F.lit("")), F.concat(key, F.lit("|choice")))
        out = F.when(pattern == name, made) if out is None else out.when(pattern == name, made)
    return out


def clean_text(df: DataFrame) -> Column:
    return F.coalesce(F.col("reference"), F.col("translation")) if "translation" in df.columns else F.col("reference")


def variants(clean: DataFrame, key: str = "idx", seed: int = 42) -> DataFrame:
    """Three rows a clean record: formatting, content and combo, with the drawn pattern (``a+b`` for combo) and
    ``noisy_translation`` where rules alone make it; content texts are null until a provider filled them.

    ``clean_idx`` carries the parent; ``variant`` is 0, 1, 2."""
    tag = lambda what: F.concat(F.lit(f"{seed}|{what}|"), F.col(key).cast("string"))
    kinds = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(c).alias("noise_category")) for n, c in enumerate(("formatting", "content", "combo"))])
    rows = clean.withColumn("_k", F.explode(kinds)).select(*clean.columns, "_k.variant", "_k.noise_category")
    formatting, content, wrapper = weighted(tag("formatting"), FORMATTING_WEIGHTS), weighted(tag("content"), CONTENT_WEIGHTS), weighted(tag("combo"), COMBO_WEIGHTS)
    content = F.when(F.col("noise_category") == "combo", weighted(tag("combo-content"), CONTENT_WEIGHTS)).otherwise(content)
    rows = rows.withColumns({"_content": F.when(F.col("variant") > 0, content), "_format": F.when(F.col("variant") == 0, formatting).when(F.col("variant") == 2, wrapper)})
    by_rule = apply_rule(F.col("_format"), clean_text(clean), F.col("src_lang"), F.col("tgt_lang"), F.col("source"), tag("rule"))
    return rows.withColumns(
        {
            "clean_idx": F.col(key),
            "noise_pattern": F.concat_ws("+", "_content", "_format"),
            "combo_categories": F.when(F.col("variant") == 2, COMBO_CATEGORY),
            "content_pattern": F.col("_content"),
            "format_pattern": F.col("_format"),
            "noisy_translation": F.when(F.col("variant") == 0, by_rule),
        }
    ).drop("_content", "_format")


def fill_content(rows: DataFrame, content: Column, key: str = "idx", seed: int = 42) -> DataFrame:
    """``rows`` of :func:`variants` with the provider's ``content`` put in, wrapped for combo. A failed answer becomes the
    preamble rule under its own pattern name. Missing languages and sources are those of :func:`apply_rule`."""
    tag = F.concat(F.lit(f"{seed}|rule|"), F.col(key).cast("string"))
    args = (F.col("src_lang"), F.col("tgt_lang"), F.col("source"), tag)
    text = F.coalesce(content, apply_rule(F.lit("verbose_preamble"), clean_text(rows), *args))
    made = F.when(F.col("variant") == 1, text).when(F.col("variant") == 2, apply_rule(F.col("format_pattern"), text, *args)).otherwise(F.col("noisy_translation"))
    failed = content.isNull() & (F.col("variant") == 1)
    return rows.withColumns({"noisy_translation": made, "noise_pattern": F.when(failed, FAILED_PATTERN).otherwise(F.col("noise_pattern"))})


def single(clean: DataFrame, allowed: list[str] | None = None, rules_only: bool = False, key: str = "idx", seed: int = 42) -> DataFrame:
    """One row a record with one pattern drawn by weight among ``allowed`` (default: all), or among its rule-based ones only.
    ``noisy_translation`` is null where a provider has to make it. An unknown pattern is an error."""
    names = [p for p in (allowed or list(ALL_WEIGHTS)) if not rules_only or p in RULES]
    if not names or any(p not in ALL_WEIGHTS for p in names):
        raise ValueError(f"no such patterns: {names}")
    tag = lambda what: F.concat(F.lit(f"{seed}|{what}|"), F.col(key).cast("string"))
    drawn = clean.withColumn("noise_pattern", pick_pattern(tag("single"), names))
    return drawn.withColumn("noisy_translation", apply_rule(F.col("noise_pattern"), clean_text(clean), F.col("src_lang"), F.col("tgt_lang"), F.col("source"), tag("rule")))


def pattern_distribution(df: DataFrame, column: str) -> DataFrame:
    """``value, n, share`` by falling count, then name."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), "value")  # one row of totals
