"""Benchmark build: sample, three noisy variants, split by pair, one table; and noise of one drawn pattern a record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import ChatProvider, PlainProvider, complete
from ..functions.prompts import noise_messages
from ..operators import noise, splits
from ..sources.readers import read_jsonl, reuse_or
from ..sources.writers import write_jsonl

#: Most tokens of a provider's noisy text.
NOISE_TOKENS = 4096
CLEAN = ("idx", "lp", "source", "reference", "src_lang", "tgt_lang")


def clean_base(clean: DataFrame, per_pair: int | None, seed: int) -> DataFrame:
    base = clean.select(*CLEAN).where("reference is not null").dropDuplicates(["idx"])
    return splits.sample_per_group(base, "lp", "idx", per_pair, seed) if per_pair else base


def _asked(rows: DataFrame, pattern: str) -> DataFrame:
    return rows.withColumn("messages", noise_messages(F.col(pattern), *[F.col(c) for c in ("source", "reference", "src_lang", "tgt_lang")]))


def noisy_variants(base: DataFrame, seed: int, provider: Callable[[], ChatProvider]) -> DataFrame:
    """The three variants of each record; content comes from the provider and is kept as it is. No text is null."""
    rows = noise.variants(base, "idx", seed)
    answered = complete(_asked(rows.where("content_pattern is not null"), "content_pattern"), "messages", provider, max_tokens=NOISE_TOKENS)
    filled = noise.fill_content(answered, F.col("raw_response"), "idx", seed).drop("messages", "raw_response")
    return rows.where("content_pattern is null").unionByName(filled)


def build_benchmark(clean: DataFrame, per_pair: int | None = 100, seed: int = 42, provider: Callable[[], ChatProvider] = PlainProvider) -> DataFrame:
    """Benchmark rows of a clean table ``(idx, lp, source, reference, src_lang, tgt_lang)``; content noise comes from the
    provider. Repeated rows count once."""
    parents = splits.stratified_split(splits.ordinals(clean_base(clean, per_pair, seed), "lp", "idx"), "lp", "idx", seed)
    return splits.benchmark_rows(parents, noisy_variants(parents, seed, provider))


def build_to(clean: DataFrame, folder: str, per_pair: int | None = 100, seed: int = 42, provider: Callable[[], ChatProvider] = PlainProvider, skip_sampling: bool = False, skip_generation: bool = False) -> DataFrame:
    """The build with its steps in ``folder``: the sample and the variants (used again if the switches say so and they are
    there), and ``dev.jsonl`` and ``test.jsonl``. Gives the statistics."""
    spark = clean.sparkSession
    sample = reuse_or(spark, f"{folder}/clean_samples", lambda: clean_base(clean, per_pair, seed), skip_sampling)
    parents = splits.stratified_split(splits.ordinals(sample, "lp", "idx"), "lp", "idx", seed)
    variants = reuse_or(spark, f"{folder}/noisy_variants", lambda: noisy_variants(parents, seed, provider), skip_generation)
    rows = splits.benchmark_rows(parents, variants)
    for name in ("dev", "test"):
        write_jsonl(rows.where(F.col("split") == name), f"{folder}/{name}.jsonl")
    schema = rows.schema
    return splits.benchmark_statistics(read_jsonl(spark, f"{folder}/dev.jsonl", schema).unionByName(read_jsonl(spark, f"{folder}/test.jsonl", schema)))


def single_noise(clean: DataFrame, allowed: list[str] | None = None, rules_only: bool = False, seed: int = 42, provider: Callable[[], ChatProvider] = PlainProvider) -> DataFrame:
    """``clean`` with ``noise_pattern`` and ``noisy_translation``: one pattern a record. A provider that fails leaves the preamble
    rule under its own pattern name."""
    rows = noise.single(clean, allowed, rules_only, "idx", seed)
    if rules_only:
        return rows
    asked = complete(_asked(rows.where("noisy_translation is null"), "noise_pattern"), "messages", provider, max_tokens=NOISE_TOKENS)
    spare = noise.apply_rule(F.lit("verbose_preamble"), noise.clean_text(clean), F.col("src_lang"), F.col("tgt_lang"), F.col("source"), F.concat(F.lit(f"{seed}|rule|"), F.col("idx").cast("string")))
    made = asked.withColumns({"noise_pattern": F.when(F.col("raw_response").isNull(), noise.FAILED_PATTERN).otherwise(F.col("noise_pattern")), "noisy_translation": F.coalesce("raw_response", spare)})
    return rows.where("noisy_translation is not null").unionByName(made.select(*rows.columns))
