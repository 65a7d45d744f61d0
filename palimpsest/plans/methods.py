"""Extraction methods: best span, best span with cleanup and language check, and a language-model extractor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleanup import clean_formatting
from ..functions.models import ChatProvider, EchoProvider, LengthScorer, SpanScorer, complete
from ..functions.parsing import parse_extractor
from ..functions.prompts import single_turn
from ..functions.scripts import is_correct_language
from ..functions.text import coverage
from ..operators.spans import extract_best_span


def span_method(items: DataFrame, key: str = "idx", scorer: Callable[[], SpanScorer] = LengthScorer) -> DataFrame:
    return extract_best_span(items, key, "source", "translation", scorer)


def clean_method(items: DataFrame, key: str = "idx", scorer: Callable[[], SpanScorer] = LengthScorer) -> DataFrame:
    """Best span, then formatting cleanup, then the script check of the target language."""
    found = span_method(items, key, scorer).withColumnRenamed("best_span", "best_span_raw")
    text = clean_formatting(F.col("best_span_raw"))
    return found.withColumn("extracted_text", text).withColumns(
        {
            "coverage": coverage(F.col("extracted_text"), F.col("translation")),
            "language_correct": is_correct_language(F.col("extracted_text"), F.col("tgt_lang")),
            "detected_lang": F.lit(None).cast("string"),
        }
    )


def llm_method(items: DataFrame, provider: Callable[[], ChatProvider] = EchoProvider) -> DataFrame:
    """The provider's extraction with predicted pattern and coverage."""
    prompt = F.concat(F.lit("Give only the clean translation as JSON.\nSource: "), F.coalesce("source", F.lit("")), F.lit("\nOutput: "), F.coalesce("translation", F.lit("")))
    answered = complete(items.withColumn("messages", single_turn(prompt)), "messages", provider)
    return answered.withColumn("_r", parse_extractor(F.col("raw_response"), F.col("translation"))).select(*items.columns, "_r.*")
