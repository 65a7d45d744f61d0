"""Queries of the training-data operators, and SQL for those that SQL can express. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import consensus, groups, langcrf, leaks, mixing, pagespam, pairs, truncation, unicode_forms
from .tables import plain_source, read

SPLIT_SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    benchmark = read(spark, d, "benchmark")
    return langcrf.mislabelled(benchmark, langcrf.fit_from(benchmark))


def p1_passages(spark: SparkSession, d: str) -> DataFrame:
    """Language, length and confidence of every passage of every distinct translation."""
    benchmark = read(spark, d, "benchmark")
    rows = benchmark.select("idx", "translation").where("translation is not null").distinct()
    found = langcrf.label_passages(rows, "idx", "translation", langcrf.fit_from(benchmark))
    return found.select(F.col("rec_id").alias("idx"), F.posexplode("passages").alias("place", "p")).select(
        "idx", "place", F.col("p.language").alias("lang"), F.col("p.words").alias("n_words"), F.col("p.han").alias("n_han"), F.round("p.confidence", 4).alias("confidence")
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.dissenting_votes(read(spark, d, "silver_label"))


def p2_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus.reliability(read(spark, d, "silver_label"))


def p2_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.krippendorff(read(spark, d, "silver_label")).withColumn("alpha", F.round("alpha", 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    benchmark = read(spark, d, "benchmark")
    return pairs.defective_pairs(benchmark, read(spark, d, "llm_result"), langcrf.fit_from(benchmark))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    benchmark = unicode_forms.disguised_rows(read(spark, d, "benchmark"), "idx", "translation", "reference", "benchmark")
    return benchmark.unionByName(unicode_forms.disguised_rows(read(spark, d, "llm_result"), "result_id", "extracted_text", "reference", "llm_result"))


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The texts of benchmark (rec_id = idx) and llm_result (rec_id = result_id) in canonical form; benchmark has no extracted_text."""
    texts = ["reference", "translation", "extracted_text"]
    benchmark = read(spark, d, "benchmark").select(F.lit("benchmark").alias("tbl"), F.col("idx").alias("rec_id"), *texts[:2], F.lit(None).cast("string").alias(texts[2])).distinct()
    results = read(spark, d, "llm_result").select(F.lit("llm_result").alias("tbl"), F.col("result_id").alias("rec_id"), *texts).distinct()
    return unicode_forms.normalise_columns(benchmark.unionByName(results), texts)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_rows(read(spark, d, "benchmark"), read(spark, d, "model_output"), read(spark, d, "llm_result"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """How often each model, method and pair cuts."""
    benchmark, outputs, results = (read(spark, d, t) for t in ("benchmark", "model_output", "llm_result"))
    cut = truncation.cut_lineage(truncation.cut_rows(benchmark, outputs, results))
    parts = (
        (benchmark.select(F.col("idx").alias("rec_id"), "lp").distinct(), "benchmark", "lp"),
        (outputs.select(F.col("out_id").alias("rec_id"), F.lower(F.trim("model")).alias("model")).distinct(), "model_output", "model"),
        (outputs.select(F.col("out_id").alias("rec_id"), "lp").distinct(), "model_output", "lp"),
        (results.select(F.col("result_id").alias("rec_id"), "method").distinct(), "llm_result", "method"),
        (results.select(F.col("result_id").alias("rec_id"), "lp").distinct(), "llm_result", "lp"),
    )
    reports = [truncation.cut_report(rows, cut.where(F.col("tbl") == table).select("rec_id"), F.col(by), f"{table}.{by}") for rows, table, by in parts]
    out = reports[0]
    for more in reports[1:]:
        out = out.unionByName(more)
    return out


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.broken_groups(read(spark, d, "benchmark"))


def p6_assignment(spark: SparkSession, d: str) -> DataFrame:
    return groups.assign_splits(read(spark, d, "benchmark"), SPLIT_SHARES)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(read(spark, d, "documents"), read(spark, d, "heldout_item"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items and the number of documents each is in."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(read(spark, d, "documents"), read(spark, d, "mix_target"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_report(read(spark, d, "documents"), read(spark, d, "mix_target"))


def p8_exact(spark: SparkSession, d: str) -> DataFrame:
    """The report of the largest mixture in which every source with documents has its share."""
    return mixing.mixture_report(read(spark, d, "documents"), read(spark, d, "mix_target"), exact=True)


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters of each source in its plain spelling: what the budgets are set against."""
    return (
        read(spark, d, "documents")
        .groupBy(plain_source(F.col("source")).alias("source"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pagespam.spam_pages(read(spark, d, "documents"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return pagespam.page_scores(read(spark, d, "documents")).withColumn("spam_share", F.round("spam_share", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_passages, p2_found, p2_reliability, p2_agreement, p3_found, p4_found, p4_canonical, p5_found, p5_report, p6_found,
        p6_assignment, p7_found, p7_items, p8_mixture, p8_report, p8_exact, p8_sources, p9_found, p9_scores,
    )
}

SQL: dict[str, str] = {
    "p2_agreement": r"""
        WITH latest AS (
            SELECT idx, coalesce(silver_model, chr(1)) AS annotator,
                   arg_max(coalesce(silver_extracted_translation, ''), (run_at, loaded_at, coalesce(silver_extracted_translation, ''))) AS raw
            FROM silver_label WHERE idx IS NOT NULL GROUP BY 1, 2),
        votes AS (SELECT idx, annotator, regexp_replace(nfc_normalize(raw), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS label FROM latest),
        cells AS (SELECT idx, label, count(*) AS n FROM votes GROUP BY 1, 2),
        paired AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY idx) AS m FROM cells) WHERE m > 1),
        seen AS (SELECT count(DISTINCT idx) AS n_items, sum(n) AS total, sum(n * (m - n) / (m - 1)::DOUBLE) AS observed FROM paired),
        spread AS (SELECT sum(c::DOUBLE * c) AS squares FROM (SELECT sum(n) AS c FROM paired GROUP BY label))
        SELECT n_items::BIGINT AS n_items, total::BIGINT AS n_values,
               round(1 - observed / ((total::DOUBLE * total - squares) / (total - 1)), 6) AS alpha
        FROM seen, spread""",
    "p8_sources": r"""
        SELECT nullif(regexp_replace(lower(trim(source)), '[\s_]+', '-', 'g'), '') AS source, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars
        FROM documents GROUP BY 1""",
}
