"""Detection, extraction and noise-prediction metrics as aggregates.

All take one row an instance and give long tables, so several methods are measured in one pass by grouping on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_exact_match, noise_category, normalize_text, strip

SYNTHETIC_CATEGORIES = ("formatting", "content", "explanation", "combo", "clean")


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0.0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _counts(gold: Column, pred: Column) -> list[Column]:
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return [n((pred == 1) & (gold == 1)).alias("tp"), n((pred == 1) & (gold == 0)).alias("fp"), n((pred == 0) & (gold == 1)).alias("fn"), F.count(F.lit(1)).alias("total")]


def _rates(df: DataFrame, keys: list[str]) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r, tn = ratio(tp, tp + fp), ratio(tp, tp + fn), F.col("total") - tp - fp - fn
    return df.select(*keys, "tp", "fp", "fn", tn.alias("tn"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(tp + tn, F.col("total")).alias("accuracy"))


def binary_metrics(df: DataFrame, gold: str, pred: str, keys: list[str] | None = None) -> DataFrame:
    """Counts and rates of the positive class 1 by ``keys``. What is neither tp, fp nor fn counts as tn, null gold included."""
    keys = keys or []
    return _rates(df.groupBy(*keys).agg(*_counts(F.col(gold), F.col(pred))), keys)


def _levels(df: DataFrame, keys: list[str], category: str, values: list[str], whole: bool) -> DataFrame:
    """A narrow row for each level an instance counts in: its category, ``noisy_only`` if that is not ``clean``, and ``all``."""
    own = F.coalesce(F.col(category), F.lit("unknown"))
    levels = [own, F.when(own != "clean", "noisy_only"), *([F.lit("all")] if whole else [])]
    return df.select(*keys, *values, F.explode(F.array_compact(F.array(*levels))).alias("category"))


def category_breakdown(df: DataFrame, gold: str, pred: str, category: str, keys: list[str] | None = None) -> DataFrame:
    """:func:`binary_metrics` by category, with a row ``noisy_only`` over all categories but ``clean``. Each instance is counted
    in both levels by one pre-aggregated group-by."""
    keys = keys or []
    by = _levels(df, keys, category, [gold, pred], False).groupBy(*keys, "category").agg(*_counts(F.col(gold), F.col(pred)))
    return _rates(by, [*keys, "category"])


def detection_prediction(extracted: Column, original: Column) -> Column:
    """1 (noisy) where the extraction is missing, blank or not the original."""
    gone = extracted.isNull() | (strip(extracted) == "")
    return F.when(gone, 1).when(is_exact_match(extracted, F.coalesce(original, F.lit(""))), 0).otherwise(1)


def extraction_match(extracted: Column, truth: Column) -> Column:
    """Both empty: right. One empty: wrong. Else exact match."""
    return normalize_text(extracted) == normalize_text(truth)


def extraction_metrics(df: DataFrame, match: str, category: str, keys: list[str] | None = None) -> DataFrame:
    """``accuracy, correct, total`` over all instances (category ``all``), by category and ``noisy_only``."""
    keys = keys or []
    by = _levels(df, keys, category, [match], True).groupBy(*keys, "category").agg(F.sum(F.col(match).cast("bigint")).alias("correct"), F.count(F.lit(1)).alias("total"))
    return by.select(*keys, "category", "correct", "total", ratio(F.col("correct"), F.col("total")).alias("accuracy"))


def mean_coverage(df: DataFrame, cover: str, keys: list[str] | None = None) -> DataFrame:
    """Mean coverage over the instances with an extraction, that is with a value of ``cover``."""
    keys = keys or []
    return df.where(F.col(cover).isNotNull()).groupBy(*keys).agg(F.avg(cover).alias("avg_coverage"))


def _noisy(df: DataFrame, is_noisy: str) -> DataFrame:
    return df.where(F.coalesce(F.col(is_noisy), F.lit(1)) == 1)


def noise_prediction(df: DataFrame, is_noisy: str, predicted: str, gold_pattern: str, gold_category: str, keys: list[str] | None = None) -> DataFrame:
    """Pattern and category accuracy over all noisy instances; those without prediction count as wrong. Keys without any
    prediction have no row."""
    keys = keys or []
    said = F.col(predicted).isNotNull() & (F.col(predicted) != "")
    hit = lambda a, b: F.sum(F.when(said & a.eqNullSafe(b), 1).otherwise(0))
    agg = (
        df.withColumn("_noisy", F.coalesce(F.col(is_noisy), F.lit(1)) == 1)
        .groupBy(*keys)
        .agg(
            F.max(F.col(predicted).isNotNull()).alias("_any"),
            F.sum(F.when(F.col("_noisy"), 1).otherwise(0)).alias("total_noisy"),
            hit(F.when(F.col("_noisy"), F.col(predicted)), F.coalesce(F.col(gold_pattern), F.lit(""))).alias("pattern_correct"),
            F.sum(F.when(F.col("_noisy") & said & noise_category(F.col(predicted)).eqNullSafe(F.coalesce(F.col(gold_category), F.lit(""))), 1).otherwise(0)).alias("category_correct"),
        )
    )
    kept = agg.where(F.col("_any") & (F.col("total_noisy") > 0))
    return kept.select(*keys, "total_noisy", "pattern_correct", "category_correct", ratio(F.col("pattern_correct"), F.col("total_noisy")).alias("pattern_accuracy"), ratio(F.col("category_correct"), F.col("total_noisy")).alias("category_accuracy"))


def category_confusion(df: DataFrame, is_noisy: str, predicted: str, gold_category: str, keys: list[str] | None = None) -> DataFrame:
    """Long gold x predicted category counts over the noisy instances, square over the union of labels and zero filled."""
    keys = keys or []
    pairs = _noisy(df, is_noisy).select(*keys, F.col(gold_category).alias("gold"), noise_category(F.col(predicted)).alias("pred"))
    counts = pairs.where("gold is not null and gold <> '' and pred is not null and pred <> ''").groupBy(*keys, "gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    # a label domain of a few names by key
    labels = counts.select(*keys, F.explode(F.array("gold", "pred")).alias("label")).distinct()
    grid = labels.withColumnRenamed("label", "gold").join(labels.withColumnRenamed("label", "pred"), keys) if keys else labels.withColumnRenamed("label", "gold").crossJoin(labels.withColumnRenamed("label", "pred"))
    return grid.join(counts, [*keys, "gold", "pred"], "left").na.fill(0, ["n"])


def evaluation_mode(df: DataFrame, category: str = "noise_category", reference: str = "reference", translation: str = "translation") -> DataFrame:
    """One row ``mode``: ``synthetic`` if a known category occurs and a non-empty reference differs from its translation."""
    known = F.bool_or(F.col(category).isin(*SYNTHETIC_CATEGORIES)) if category in df.columns else F.lit(False)
    differs = F.bool_or((F.coalesce(F.col(reference), F.lit("")) != "") & ~F.col(reference).eqNullSafe(F.col(translation)))
    return df.agg(F.coalesce(known, F.lit(False)).alias("a"), F.coalesce(differs, F.lit(False)).alias("b")).select(F.when(F.col("a") & F.col("b"), "synthetic").otherwise("curated").alias("mode"))


def truth_column(df: DataFrame, mode: str) -> str | None:
    """Name of the ground truth: ``gold_clean`` or ``reference`` (synthetic), ``silver_reference`` or none (curated)."""
    if mode == "synthetic":
        return "gold_clean" if "gold_clean" in df.columns else "reference"
    return "silver_reference" if "silver_reference" in df.columns else None


def category_column(df: DataFrame) -> str | None:
    """The column that names an instance's category: ``noise_category``, else ``perturbation_type``, else none."""
    return next((c for c in ("noise_category", "perturbation_type") if c in df.columns), None)
