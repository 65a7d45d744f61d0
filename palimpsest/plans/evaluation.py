"""Evaluation of extraction methods: each result text is read once, then everything is aggregates."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import parse_result
from ..functions.text import coverage, gold_is_noisy
from ..operators import metrics
from ..operators.align import align, latest
from ..session import barrier, materialize
from ..sources.readers import exists, method_name, read_jsonl
from ..sources.writers import write_text


NEEDED = ("result_id", "method", "noise_category", "noise_pattern", "predicted_noise_pattern", "label", "loaded_at")


def evaluation_rows(results: DataFrame, mode: str = "synthetic") -> DataFrame:
    """One narrow row a result: ``result_id, method, noise_category, noise_pattern, predicted_pattern, is_noisy, pred, match,
    cover``. Of results delivered twice the later delivery counts.

    Texts are read where they lie and only what was found of them is shuffled. ``match`` is null in a mode without a truth;
    ``cover`` is null without an extraction. The category is ``noise_category`` or, where that is no column,
    ``perturbation_type``."""
    truth = metrics.truth_column(results, mode)
    category = metrics.category_column(results)
    columns = [c for c in NEEDED if c in results.columns and c != "noise_category"]
    rows = barrier(results, _p=parse_result(F.col("extracted_text")))
    span = [F.col("best_span")] if "best_span" in rows.columns else []
    rows = barrier(rows, _found=F.coalesce(*span, F.col("_p.extracted")))
    found, said = F.col("_found"), F.lit(None).cast("string")
    if "predicted_noise_pattern" in columns:
        said = F.when(F.col("predicted_noise_pattern") != "", F.col("predicted_noise_pattern"))
    read = rows.select(
        *[c for c in columns if c not in ("predicted_noise_pattern", "label")],
        (F.lit(None).cast("string") if category is None else F.col(category)).alias("noise_category"),
        F.coalesce(said, F.col("_p.noise_pattern")).alias("predicted_pattern"),
        (gold_is_noisy(F.col("label")) if "label" in columns else F.lit(1)).alias("is_noisy"),
        metrics.detection_prediction(found, F.col("translation")).alias("pred"),
        (F.lit(None).cast("boolean") if truth is None else metrics.extraction_match(found, F.col(truth))).alias("match"),
        F.when(found.isNotNull(), coverage(found, F.col("translation"))).alias("cover"),
    )
    return latest(read, ["result_id"], ["loaded_at"]).drop("loaded_at") if "loaded_at" in columns else read


def evaluate(results: DataFrame, mode: str = "synthetic") -> dict[str, DataFrame]:
    """All metric tables by method, from one written pass over the results; those of texts only where there is a truth."""
    rows = materialize(evaluation_rows(results, mode))
    tables = {
        "detection": metrics.binary_metrics(rows, "is_noisy", "pred", ["method"]),
        "detection_breakdown": metrics.category_breakdown(rows, "is_noisy", "pred", "noise_category", ["method"]),
        "extraction": metrics.extraction_metrics(rows, "match", "noise_category", ["method"]),
        "coverage": metrics.mean_coverage(rows, "cover", ["method"]),
        "noise_prediction": metrics.noise_prediction(rows, "is_noisy", "predicted_pattern", "noise_pattern", "noise_category", ["method"]),
        "confusion": metrics.category_confusion(rows, "is_noisy", "predicted_pattern", "noise_category", ["method"]),
    }
    if metrics.truth_column(results, mode) is None:
        del tables["extraction"]
    return tables


RESULT_FIELDS = "extracted_text string, best_span string, predicted_noise_pattern string"
BENCHMARK_FIELDS = "source string, reference string, translation string, label int, noise_category string, perturbation_type string, noise_pattern string, gold_clean string, silver_reference string"
_LINE = "_line"


def _present(df: DataFrame, optional: list[str]) -> DataFrame:
    """``df`` without the optional columns in which nothing is said."""
    said = df.agg(*[F.count(c).alias(c) for c in optional]).first() or {}
    return df.drop(*[c for c in optional if not said[c]])


def evaluate_files(spark: SparkSession, benchmark: str, results: list[str], mode: str = "auto", out: str | None = None) -> tuple[str, dict[str, DataFrame], list[str]]:
    """The mode, the metric tables and the paths left out of result files aligned line by line with a benchmark file.

    A result file that is not there or has another number of lines than the benchmark is left out, as are all metrics of texts in
    a curated set without ``silver_reference``. With ``out`` the metrics are written there as JSON."""
    bench = materialize(_present(read_jsonl(spark, benchmark, BENCHMARK_FIELDS, key=_LINE), ["noise_category", "perturbation_type", "gold_clean", "silver_reference", "label"]))
    n = bench.count()
    if mode == "auto":
        mode = (metrics.evaluation_mode(bench, metrics.category_column(bench) or "noise_category").first() or ["curated"])[0]
    kept, left_out = [], []
    for path in results:
        rows = read_jsonl(spark, path, RESULT_FIELDS, key=_LINE) if exists(spark, path) else None
        if rows is None or rows.count() != n:
            left_out.append(path)
            continue
        kept.append(rows.withColumn("method", method_name(F.lit(path))))
    if not kept:
        raise ValueError("no result file fits the benchmark")
    joined = align(bench, reduce(DataFrame.unionByName, kept), _LINE)
    tables = evaluate(joined.withColumn("result_id", F.col(_LINE)), mode)
    if out:
        small = {name: [row.asDict() for row in df.collect()] for name, df in tables.items()}  # a row a method and category
        write_text(spark, out, json.dumps({"benchmark": benchmark, "eval_mode": mode, "num_instances": n, "metrics": small}, ensure_ascii=False, indent=2))
    return mode, tables, left_out
