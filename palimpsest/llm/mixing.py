"""Problem 8: mixing sources to target weights.

Documents get a hash-random key; within each source a distributed prefix sum of token counts in key order finds the exact
cut of the source's budget. A source with more budget than tokens is used in whole epochs, up to its cap, and then cut.

The size of the mixture is the tokens of all sources with a target (sources that are too small for their share then fall short,
which the report states), or, with ``exact``, the largest at which every source that has documents reaches its share.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import prefix_sums
from ..session import materialize
from .tables import plain_source

#: Vocabulary of a public tokenizer (byte-pair ranks); a file of the driver, which ships it to the executors.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED = 8


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, n_tokens)``, source in plain spelling; null text has no tokens."""
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            yield pd.Series([0 if t is None else len(encode(t)) for t in batch], dtype="int64", index=batch.index)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_source(F.col("source")).alias("source"), F.pandas_udf(run, "bigint")("text").alias("n_tokens"))


def budgets(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None, exact: bool = False) -> DataFrame:
    """``(source, target_share, max_repeats, have, n_docs, budget, epochs, rest)`` of each target.

    A source gives ``min(share x size, have x max_repeats)`` tokens: ``epochs`` whole passes and ``rest`` tokens of one more."""
    wanted = targets.groupBy(plain_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    held = counts.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.count(F.lit(1)).alias("n_docs"))
    sized = wanted.join(held, "source", "left").na.fill(0, ["have", "n_docs"])
    reach = F.when((F.col("have") > 0) & (F.col("target_share") > 0), F.col("have") * F.col("max_repeats") / F.col("target_share"))
    whole = F.lit(total_tokens).cast("bigint") if total_tokens is not None else F.min(reach) if exact else F.sum("have")
    sized = sized.crossJoin(F.broadcast(sized.agg(F.max("have").alias("_most"), whole.alias("size"))))  # one row
    budget = F.least(F.floor(F.col("target_share") * F.col("size")), F.col("have") * F.col("max_repeats"))
    sized = sized.withColumn("budget", F.coalesce(budget, F.lit(0)).cast("bigint"))
    epochs = F.when(F.col("have") > 0, F.floor(F.col("budget") / F.col("have"))).otherwise(0).cast("bigint")
    return sized.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("have")).drop("size", "_most")


def _copies(counts: DataFrame, plan: DataFrame) -> DataFrame:
    """``(doc_id, source, n_tokens, copies)`` of every document of a planned source; counts and plan as above."""
    # one row a target: a fixed, small table
    plan = plan.select("source", "epochs", "rest", "max_repeats")
    ordered = prefix_sums(counts.join(plan.select("source"), "source", "left_semi"), ["source"], F.xxhash64("doc_id", F.lit(SEED)), "n_tokens")
    once_more = (F.col("before") + F.col("n_tokens") / 2 <= F.col("rest")) & (F.col("rest") > 0) & (F.col("epochs") < F.col("max_repeats"))
    return ordered.join(plan, "source").select("doc_id", "source", "n_tokens", (F.col("epochs") + once_more.cast("bigint")).alias("copies"))


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, total_tokens: int | None = None, exact: bool = False) -> DataFrame:
    """``(doc_id, source, n_tokens, copies)`` of every document that is used. The document in which a source's budget ends
    is taken if the budget reaches its middle, and only while the cap of repeats allows, so a source misses its budget by at
    most half a document."""
    counts = materialize(token_counts(documents, vocabulary))
    return _copies(counts, budgets(counts, targets, total_tokens, exact)).where("copies > 0")


def mixture_report(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, total_tokens: int | None = None, exact: bool = False) -> DataFrame:
    """``(source, target_share, max_repeats, n_docs, have_tokens, budget_tokens, mixed_tokens, actual_share, missing_share,
    most_copies)`` of each target; ``missing_share`` is what the target lacks."""
    counts = materialize(token_counts(documents, vocabulary))
    plan = budgets(counts, targets, total_tokens, exact)
    taken = _copies(counts, plan).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed"), F.max("copies").alias("most"))
    both = plan.join(taken, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed", F.lit(0)))
    share = F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0))
    return both.crossJoin(F.broadcast(taken.agg(F.sum("mixed").alias("all_tokens")))).select(  # one row
        "source", "target_share", "max_repeats", "n_docs", F.col("have").alias("have_tokens"), F.col("budget").alias("budget_tokens"), "mixed_tokens", share.alias("actual_share"),
        F.greatest(F.col("target_share") - share, F.lit(0.0)).alias("missing_share"), F.coalesce("most", F.lit(0)).alias("most_copies"),
    )
