"""The stateless operators on streams: cleanup, rule classification and language check take a ``readStream`` unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleanup import clean_formatting
from ..operators.rulebase import classify


def clean_stream(stream: DataFrame, text: str = "translation") -> DataFrame:
    return stream.withColumn("cleaned", clean_formatting(F.col(text)))


def classify_stream(stream: DataFrame) -> DataFrame:
    return classify(stream)


def windowed_issue_rate(stream: DataFrame, at: str = "produced_at", late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Clean and faulty outputs a model and window of event time; rows later than ``late`` are left out by the watermark."""
    marked = classify(stream.withWatermark(at, late))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return marked.groupBy(F.window(at, width), "model").agg(F.count(F.lit(1)).alias("total"), n(F.col("label") == 1).alias("clean"))
