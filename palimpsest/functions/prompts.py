"""Requests to language models as columns of chat messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language names by code.
LANGUAGE_NAMES = {
    "en": "English", "zh": "Chinese", "fr": "French", "de": "German", "ar": "Arabic", "ru": "Russian", "he": "Hebrew", "cs": "Czech",
    "pl": "Polish", "ta": "Tamil", "km": "Khmer", "ko": "Korean", "it": "Italian", "es": "Spanish", "ja": "Japanese",
    "pt": "Portuguese", "tr": "Turkish",
}
MESSAGES = "array<struct<role:string,content:string>>"
#: Most code points of each text in an annotator's request.
TRANSLATION_LIMIT, SOURCE_LIMIT, REFERENCE_LIMIT = 10_000, 5_000, 5_000

SYSTEM_NOISE = "You rewrite a clean translation the way a talkative model would have put it out. Answer with the rewritten output only."
SYSTEM_LABEL = 'You find the clean translation inside a model output. Answer with a JSON object with the field "extracted_translation".'
#: What each kind of content noise asks for, with a system message of its own where the translation is not kept.
NOISE_REQUESTS: dict[str, str] = {
    "explanation": "Keep the translation and add a remark below it on how it was made.",
    "cultural_note": "Keep the translation and add a note on a custom or place it mentions.",
    "bilingual_output": "Give the source and the translation together.",
    "alternatives": "Keep the translation and add another way to say it.",
    "verbose_preamble": "Put a wordy announcement before the translation.",
    "wrong_language": "Translate into a language that is neither source nor target.",
    "off_topic": "Write about something else in the target language.",
}
NOISE_SYSTEMS: dict[str, str] = {
    "wrong_language": "You translate into the wrong language without saying so. Answer with the output only.",
    "off_topic": "You answer something that was not asked. Answer with the output only.",
}
#: One worked example of each kind of content noise.
EXAMPLES: dict[str, tuple[str, str]] = {
    "explanation": ("English source: The gate is closed.\nFrench translation: La porte est fermée.", "La porte est fermée.\n\nThe verb is in the passive as in the source."),
    "cultural_note": ("English source: They drank mate.\nGerman translation: Sie tranken Mate.", "Sie tranken Mate.\n\nMate is an infusion that is shared in company."),
    "bilingual_output": ("English source: Tomorrow it rains.\nGerman translation: Morgen regnet es.", "Tomorrow it rains.\nMorgen regnet es."),
    "alternatives": ("English source: Tomorrow it rains.\nGerman translation: Morgen regnet es.", "Morgen regnet es.\n\nAlso possible: Es regnet morgen."),
    "verbose_preamble": ("English source: Good night.\nItalian translation: Buona notte.", "Of course, I put this into Italian with pleasure:\n\nBuona notte."),
    "wrong_language": ("English source: The train is late.\nGerman translation: Der Zug hat Verspätung.", "El tren llega tarde."),
    "off_topic": ("English source: The shop opens at nine.\nFrench translation: Le magasin ouvre à neuf heures.", "Les pommiers fleurissent au printemps."),
}


def language_name(code: Column) -> Column:
    """Name of a language code; an unknown code in upper case; null for null."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(table, F.coalesce(code, F.lit(""))), F.upper(code)))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def single_turn(prompt: Column) -> Column:
    return F.array(_message("user", prompt))


def chat(system: Column, prompt: Column) -> Column:
    return F.array(_message("system", system), _message("user", prompt))


def noise_messages(pattern: Column, source: Column, clean: Column, src_lang: Column, tgt_lang: Column) -> Column:
    """System message, worked examples and the request of a noise pattern; null for a pattern without request only: a null
    language is English or Chinese, as in the rules, and a null text is empty."""
    source, clean = F.coalesce(source, F.lit("")), F.coalesce(clean, F.lit(""))
    src_lang, tgt_lang = F.coalesce(src_lang, F.lit("en")), F.coalesce(tgt_lang, F.lit("zh"))
    ask = F.create_map(*[F.lit(x) for pair in NOISE_REQUESTS.items() for x in pair])
    own = F.create_map(*[F.lit(x) for pair in NOISE_SYSTEMS.items() for x in pair])
    request = F.concat(F.try_element_at(ask, pattern), F.lit("\n"), language_name(src_lang), F.lit(" source: "), source, F.lit("\n"), language_name(tgt_lang), F.lit(" translation: "), clean)
    system = F.coalesce(F.try_element_at(own, pattern), F.lit(SYSTEM_NOISE))
    shots = F.create_map(*[x for name, (asked, said) in EXAMPLES.items() for x in (F.lit(name), F.array(_message("user", F.lit(asked)), _message("assistant", F.lit(said))))])
    return F.when(request.isNotNull(), F.concat(F.array(_message("system", system)), F.try_element_at(shots, pattern), F.array(_message("user", request))))


# The marks put where a text was cut.
SHORT_MARK, LONG_MARK = " [... truncated ...]", "\n[... truncated ...]"


def _cut(text: Column, limit: int, mark: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def silver_prompt(translation: Column, source: Column, reference: Column, src_lang: Column, tgt_lang: Column, patterns: Column) -> Column:
    """An annotator's request; long texts are cut at their limits with a mark, missing values have stand-ins."""
    kinds = F.when(patterns.isNull() | (F.size(patterns) == 0), "unknown").otherwise(F.array_join(patterns, ", "))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Languages: "), F.coalesce(src_lang, F.lit("?")), F.lit(" to "), F.coalesce(tgt_lang, F.lit("?"))),
        F.concat(F.lit("Noise: "), kinds),
        F.concat(F.lit("Source: "), _cut(source, SOURCE_LIMIT, SHORT_MARK)),
        F.concat(F.lit("Reference: "), _cut(reference, REFERENCE_LIMIT, SHORT_MARK)),
        F.concat(F.lit("Output: "), _cut(translation, TRANSLATION_LIMIT, LONG_MARK)),
    )
