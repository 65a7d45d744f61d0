"""Silver labels: requests, responses, agreement and aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import ChatProvider, EchoProvider, complete
from ..functions.parsing import parse_silver, read_silver
from ..functions.prompts import SYSTEM_LABEL, chat, silver_prompt
from ..operators.align import latest
from ..operators.votes import silver_reference


#: Most tokens of an annotator's answer.
LABEL_TOKENS = 9216


def label_items(curated: DataFrame, model: str, provider: Callable[[], ChatProvider] = EchoProvider, wait: float = 1.0, **options) -> DataFrame:
    """``curated`` with ``silver_model, silver_extracted_translation, silver_raw_response``. An answer that cannot be read is asked
    for again; the last one is kept."""
    prompt = silver_prompt(*[F.col(c) for c in ("translation", "source", "reference", "src_lang", "tgt_lang", "noise_patterns")])
    asked = curated.withColumn("messages", chat(F.lit(SYSTEM_LABEL), prompt))
    answered = complete(asked, "messages", provider, "silver_raw_response", max_tokens=LABEL_TOKENS, wait=wait, accept=lambda text: read_silver(text)[0] is not None, **options)
    return answered.withColumns({"silver_model": F.lit(model), "silver_extracted_translation": parse_silver(F.col("silver_raw_response"))}).drop("messages")


def votes_table(labels: DataFrame, models: list[str]) -> DataFrame:
    """``idx, vote_0, vote_1, vote_2`` of all labelled items, by the latest run of each model; a model that did not label an item
    has a null vote there."""
    last = latest(labels.select("idx", "silver_model", "run_at", "loaded_at", "silver_extracted_translation"), ["idx", "silver_model"], ["run_at", "loaded_at"])
    pick = [F.max(F.when(F.col("silver_model") == m, F.col("silver_extracted_translation"))).alias(f"vote_{k}") for k, m in enumerate(models)]
    return last.groupBy("idx").agg(*pick)


def aggregate(labels: DataFrame, models: list[str], trusted: int = 2) -> DataFrame:
    votes = votes_table(labels, models)
    return silver_reference(votes, [f"vote_{k}" for k in range(len(models))], models, trusted)
