"""Alignment of tables on an explicit key, with the count checks that positional alignment needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LengthMismatch(ValueError):
    """Two tables that must have a row for a row do not."""


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the one with the greatest ``order`` columns, then the greatest row. Pre-aggregated, no sort."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.max(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in (*order, *rest)]).select(*df.columns)


def check_lengths(left: DataFrame, right: DataFrame) -> int:
    """Number of rows of both tables; :class:`LengthMismatch` if they differ."""
    a, b = left.count(), right.count()
    if a != b:
        raise LengthMismatch(f"{a} and {b} rows")
    return a


def align(bench: DataFrame, result: DataFrame, key: str = "idx", take: list[str] | None = None) -> DataFrame:
    """``bench`` with the columns of ``result`` that it has not (or ``take``); on a clash the result's column wins."""
    chosen = [c for c in (take or result.columns) if c != key]
    kept = [c for c in bench.columns if c not in chosen]
    return bench.select(*kept).join(result.select(key, *chosen), key)


def merge_results(items: DataFrame, results: DataFrame, key: str = "idx") -> DataFrame:
    """Input rows with their result fields; a result field replaces an input field of the same name."""
    return align(items, results, key)


def zero_fill(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Every expected key with the found numbers, zero where nothing was found."""
    numbers = [c for c, t in found.dtypes if c not in keys and t in ("int", "bigint", "double")]
    return expected.join(found, keys, "left").na.fill(0, numbers)
