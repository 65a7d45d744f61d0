"""Ordinals, per-pair splits and the rows of a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import hex_bucket, number_bucket, running_sum


def ordinals(df: DataFrame, group: str, order: str, out: str = "ordinal") -> DataFrame:
    """0-based place of each row within its group by a whole number; rows with the same number are in the order of their columns."""
    ties = [F.col(c) for c, t in df.dtypes if c not in (group, order) and not t.startswith("map")]
    return running_sum(df, [group], number_bucket(df, order), [F.col(order), *ties], F.lit(1), out)


def stratified_split(df: DataFrame, group: str, key: str, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: per group, in hash order, the first half (rounded down) is dev, the rest test."""
    keyed = df.drop("split").withColumn("_digest", F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    placed = running_sum(keyed, [group], hex_bucket(F.col("_digest")), [F.col("_digest"), F.col(key)], F.lit(1), "_place", "_size")
    return placed.withColumn("split", F.when(F.col("_place") < F.floor(F.col("_size") / 2), "dev").otherwise("test")).drop("_digest", "_place", "_size")


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows a group, chosen by hash (a sampling operator). Ranks are cut within partitions before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def entry_id(lp: Column, number: Column, suffix: Column) -> Column:
    return F.format_string("%s_%03d_%s", lp, number, suffix)


def benchmark_rows(clean: DataFrame, noisy: DataFrame) -> DataFrame:
    """Clean rows (label 1, pattern ``none``) and their noisy variants (label 0) in one table; a variant has its parent's
    number and split. ``clean`` has ``idx, ordinal, split``; ``noisy`` is :func:`.noise.variants`, filled."""
    base = ["lp", "source", "reference", "src_lang", "tgt_lang", "split"]
    first = clean.select(
        entry_id(F.col("lp"), F.col("ordinal"), F.lit("clean")).alias("id"), *base, F.col("reference").alias("translation"), F.lit(1).alias("label"), F.lit("clean").alias("noise_category"), F.lit("none").alias("noise_pattern")
    )
    more = noisy.select(
        entry_id(F.col("lp"), F.col("ordinal"), F.col("noise_category")).alias("id"), *base, F.col("noisy_translation").alias("translation"), F.lit(0).alias("label"), "noise_category", "noise_pattern"
    )
    return first.unionByName(more)


def benchmark_statistics(df: DataFrame) -> DataFrame:
    """``split, label, noise_category, n, n_lp``."""
    return df.groupBy("split", "label", "noise_category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lp").alias("n_lp"))
