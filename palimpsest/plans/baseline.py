"""The rule baseline over a tree of model outputs: discovery, the file that counts, tolerant reading, classification, report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import LanguageModel
from ..operators import align, rulebase
from ..sources import readers, writers

FIELDS = "translation string, reference string, tgt_lang string"
COUNTS = ("total", "clean", "with_issue", "has_explanation", "wrong_language")


def classified_tree(spark: SparkSession, root: str, models: list[str] | None = None, pairs: list[str] | None = None, split: str = "test", language_model: Callable[[], LanguageModel | None] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(model, lp, index, ...)`` of all outputs of a tree ``root/model/pair/file`` with their classes, and ``(model, lp)`` of all
    that was asked for. All files are one scan; a bad line is left out. The language of a line is its ``tgt_lang`` where the line
    has that field, else that of its pair."""
    models = readers.discover_models(spark, root, models)
    pairs = list(pairs or readers.PAIRS)
    grid = spark.createDataFrame([(m, lp) for m in models for lp in pairs], "model string, lp string")
    files = readers.translation_files(spark, root, models, pairs, split)
    if not files:
        empty = spark.createDataFrame([], f"model string, lp string, index bigint, {FIELDS}")
        return rulebase.classify(empty, "tgt_lang"), grid
    # as many rows as files; Spark gives paths as URIs, folders of parts have one more step
    known = spark.createDataFrame([(m, lp, "/".join(p.rsplit("/", 3)[1:]), readers.target_language_of_path(p)) for m, lp, p in files], "model string, lp string, _tail string, _target string")
    rows = readers.parsed_lines(spark, [p for *_, p in files], FIELDS, True, keep_line=True)
    uri = F.url_decode(F.regexp_replace("_path", "[+]", "%2B"))
    step = rf"([^/]+/[^/]+/{split}_translations(?:_original)?\.jsonl)(?:/[^/]*)?$"
    rows = rows.withColumn("_tail", F.regexp_extract(uri, step, 1)).join(F.broadcast(known), "_tail")
    has_field = F.col("value").rlike(r'"tgt_lang"\s*:')
    rows = rows.withColumn("tgt_lang", F.when(has_field, F.col("tgt_lang")).otherwise(F.col("_target"))).drop("value", "_tail", "_target")
    return rulebase.classify(readers.numbered(rows, "index", ["model", "lp"]), "tgt_lang", language_model), grid


def report(classified: DataFrame, grid: DataFrame) -> DataFrame:
    """Counts and rates of every model and pair asked for, zero where there is no output, with a row ``OVERALL`` a model."""
    counts = rulebase.summary(classified, ["model", "lp"]).select("model", "lp", *COUNTS)
    return rulebase.with_overall(rulebase.with_rates(align.zero_fill(grid, counts, ["model", "lp"])))


def run(spark: SparkSession, root: str, out: str | None = None, instances: str | None = None, **options) -> DataFrame:
    """The report of a tree; with ``out`` the text report is written there, with ``instances`` a TSV folder a model and pair."""
    classified, grid = classified_tree(spark, root, **options)
    table = report(classified, grid)
    if out:
        writers.write_text(spark, out, writers.baseline_text(table))
    if instances:
        writers.write_instances(classified, instances)
    return table
