"""Places and running sums in order within groups, however large a group is.

A window by group alone sorts each group in one task. Here rows are dealt to buckets that follow the order; a window sorts a bucket
of a group, and the totals of the buckets (at most groups x ``RANGES`` rows) carry the sums across."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets a group is cut into.
RANGES = 4096


def hash_bucket(key: Column) -> Column:
    """Bucket of a signed 64-bit hash, in its order."""
    return F.floor(key / F.lit(float((1 << 64) // RANGES))).cast("int")


def hex_bucket(digest: Column) -> Column:
    """Bucket of a hexadecimal digest, in its order."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def number_bucket(df: DataFrame, key: str) -> Column:
    """Bucket of a whole number, in its order: equal parts of the range of the numbers, which one aggregate finds."""
    low, high = df.agg(F.min(key), F.max(key)).first() or (None, None)
    if low is None:
        return F.lit(0)
    return F.floor((F.col(key).cast("double") - float(low)) * RANGES / (float(high) - float(low) + 1)).cast("int")


def running_sum(df: DataFrame, group: list[str], bucket: Column, order: list[Column], value: Column, out: str, total: str | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows before it in its group, and ``total``, that over the group. Null is a
    group of its own. ``order`` must be total, and ``bucket`` must follow it."""
    rows = df.withColumns({"_bucket": bucket, "_value": value})
    sums = rows.groupBy(*group, "_bucket").agg(F.sum("_value").alias("_sum"))
    whole = Window.partitionBy(*group)
    sums = sums.withColumns({"_carry": F.coalesce(F.sum("_sum").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum("_sum").over(whole)})
    sums = sums.select(*[F.col(c).alias(f"_r{k}") for k, c in enumerate((*group, "_bucket"))], "_carry", "_total")
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_r{k}")) for k, c in enumerate((*group, "_bucket"))])
    made = [(F.col("_inside") + F.coalesce("_carry", F.lit(0))).alias(out)] + ([F.col("_total").alias(total)] if total else [])
    return summed.join(sums, same, "left").select(*df.columns, *made)


def prefix_sums(df: DataFrame, group: list[str], key: Column, value: str, out: str = "before") -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the same ``group`` whose ``key`` (a 64-bit hash, ties in
    the order of the columns) is smaller."""
    keyed = df.withColumn("_key", key)
    ties = [F.col(c) for c in df.columns if c not in group and c != value]
    return running_sum(keyed, group, hash_bucket(F.col("_key")), [F.col("_key"), *ties], F.col(value), out).drop("_key")
