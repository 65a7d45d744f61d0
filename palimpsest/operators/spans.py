"""Contiguous line spans of a text and the best of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import LengthScorer, SpanScorer, score_spans
from ..functions.text import coverage, strip

#: Lines a text's spans are made of: the feature's own bound (at most 210 spans a row).
MOST_LINES = 20
LEAST_COVERAGE = 0.8


def lines_of(text: Column) -> Column:
    """Lines of a text without blank ones; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: strip(x) != "")


def spans_of(text: Column) -> Column:
    """``array<struct(text, start, end)>`` of all runs of lines, in (start, end) order, stripped, without empty ones. A text
    of at most one line is one span of the whole."""
    lines = F.slice(lines_of(text), 1, MOST_LINES)
    n = F.size(lines)
    made = lambda i, j: F.struct(strip(F.array_join(F.slice(lines, i, j - i + 1), "\n")).alias("text"), (i - 1).alias("start"), (j - 1).alias("end"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: made(i, j))))
    whole = F.array(F.struct(strip(F.coalesce(text, F.lit(""))).alias("text"), F.lit(0).alias("start"), F.lit(0).alias("end")))
    return F.filter(F.when(n > 1, runs).otherwise(whole), lambda s: s["text"] != "")


def explode_spans(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row a span: ``keep``, ``span, start, end, place`` (place is the order among the row's spans)."""
    return df.select(*keep, F.posexplode(spans_of(F.col(text))).alias("place", "_s")).select(*keep, "place", F.col("_s.text").alias("span"), F.col("_s.start").alias("start"), F.col("_s.end").alias("end"))


def best_span(spans: DataFrame, keys: list[str], score: str) -> DataFrame:
    """``best_span, best_score`` by ``keys``: the highest score, the first span on a tie. One pre-aggregated shuffle."""
    top = F.max_by(F.struct("span", score), F.struct(F.col(score), -F.col("place"))).alias("_b")
    return spans.groupBy(*keys).agg(top).select(*keys, F.col("_b.span").alias("best_span"), F.col(f"_b.`{score}`").alias("best_score"))


def extract_best_span(df: DataFrame, key: str, source: str, text: str, scorer: Callable[[], SpanScorer] = LengthScorer) -> DataFrame:
    """``df`` with ``best_span, qe_score, coverage, label`` (1 where the best span covers the text). The scorer is an
    interface; the default stand-in is no quality model."""
    spans = score_spans(explode_spans(df, text, [key, source]), source, "span", scorer)
    best = best_span(spans, [key], "score").withColumnRenamed("best_score", "qe_score")
    joined = df.drop("best_span", "qe_score", "coverage", "label").join(best, key, "left")
    share = coverage(F.col("best_span"), F.col(text))
    return joined.withColumns({"coverage": share, "label": (share >= LEAST_COVERAGE).cast("int")})
