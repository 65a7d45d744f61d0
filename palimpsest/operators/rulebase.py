"""The rule baseline over model outputs: per file, per model, and the ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.explanations import explained
from ..functions.models import LanguageModel, detect_language
from ..functions.scripts import all_shares, bare_text, language_verdict
from ..functions.text import strip
from ..session import barrier

FIELDS = ("label", "has_explanation", "wrong_language", "detected_lang", "confidence")

_SUMS = ("total", "clean", "with_issue", "has_explanation", "wrong_language")


def classify(df: DataFrame, target: str = "tgt_lang", model: Callable[[], LanguageModel | None] | None = None) -> DataFrame:
    """``df`` with ``label`` (1 is clean), ``has_explanation``, ``wrong_language``, ``detected_lang`` and ``confidence``; input fields of
    these names are replaced. Without a target language the language is not tested. With a language ``model`` its answer
    comes before the scripts.

    Each step is computed once a row: the bare texts, then the script shares, then the two flags, then the label."""
    kept = df.drop(*FIELDS)
    told = detect_language(kept, "translation", model) if model else kept.withColumns({"detected_lang": F.lit(None).cast("string"), "confidence": F.lit(0.0)})
    t, language = F.col("translation"), F.col(target)
    rows = barrier(told, _bare=bare_text(t), _text=strip(F.coalesce(t, F.lit(""))), _known=F.length(strip(F.coalesce(F.col("reference"), F.lit("")))))
    rows = barrier(rows, _shares=all_shares(F.col("_bare")))
    seen = (F.col("detected_lang"), F.col("confidence")) if model else ()
    wrong = language.isNotNull() & (language != "") & ~language_verdict(t, language, F.col("_shares"), *seen)
    flagged = barrier(rows, has_explanation=explained(F.col("_text"), F.col("_known")), wrong_language=wrong)
    label = F.when(F.col("has_explanation") | F.col("wrong_language"), 0).otherwise(1)
    return flagged.drop("_bare", "_text", "_known", "_shares").withColumn("label", label).select(*kept.columns, *FIELDS)


def with_rates(df: DataFrame) -> DataFrame:
    share = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(0.0)
    return df.withColumns({f"{c}_rate": share(c) for c in _SUMS[1:]})


def summary(classified: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates by ``keys``. The two issue flags are not exclusive."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    agg = classified.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), n(F.col("label") == 1).alias("clean"), n(F.col("label") == 0).alias("with_issue"), n(F.col("has_explanation")).alias("has_explanation"), n(F.col("wrong_language")).alias("wrong_language"))
    return with_rates(agg)


def with_overall(by_pair: DataFrame) -> DataFrame:
    """Rows by model and pair with a row ``OVERALL`` a model, the ratio of sums."""
    total = by_pair.groupBy("model").agg(*[F.sum(c).alias(c) for c in _SUMS]).withColumn("lp", F.lit("OVERALL"))
    return by_pair.unionByName(with_rates(total).select(by_pair.columns))


def ranking(by_model: DataFrame) -> DataFrame:
    """Models by falling clean rate, then name; places are row numbers. There are as many rows as models."""
    return by_model.withColumn("place", F.row_number().over(Window.orderBy(F.desc("clean_rate"), "model")))
