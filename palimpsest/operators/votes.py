"""Three votes on one item: two ways to settle them, agreement statistics, and rows to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text, strip


def _settle(votes: list[Column], alone: Column, alone_agreement: Column) -> Column:
    blank = lambda v: v.isNull() | (strip(v) == "")
    same = [F.when(~blank(v), normalize_text(v)) for v in votes]
    pair = lambda i, j: same[i].isNotNull() & (same[i] == same[j])
    made = lambda text, n: F.struct(text.alias("text"), n.cast("int").alias("agreement"))
    return (
        F.when(pair(0, 1) & pair(0, 2), made(votes[0], F.lit(3)))
        .when(pair(0, 1), made(votes[0], F.lit(2)))
        .when(pair(0, 2), made(votes[0], F.lit(2)))
        .when(pair(1, 2), made(votes[1], F.lit(2)))
        .otherwise(made(alone, alone_agreement))
    )


def majority_vote(votes: list[Column], proprietary: int = 0) -> Column:
    """``struct(text, agreement)``: the raw text two or three agree on (3, 2); else the proprietary vote, else the first
    that is not blank (1); else null (0)."""
    present = [F.when(strip(v) != "", v) for v in votes]
    alone = F.coalesce(present[proprietary], *present)
    return _settle(votes, alone, F.when(alone.isNull(), 0).otherwise(1))


def aggregate_votes(votes: list[Column], trusted: int = 2) -> Column:
    """``struct(text, agreement)``: as :func:`majority_vote`, but without agreement the trusted vote alone counts (1), null
    if it is blank."""
    return _settle(votes, F.when(strip(votes[trusted]) != "", votes[trusted]), F.lit(1))


def silver_reference(df: DataFrame, votes: list[str], models: list[str], trusted: int = 2) -> DataFrame:
    """``df`` with ``silver_reference, silver_agreement, silver_votes, silver_models``; a missing vote is exported as ''."""
    settled = aggregate_votes([F.col(v) for v in votes], trusted)
    return df.withColumn("_v", settled).withColumns(
        {
            "silver_reference": F.col("_v.text"),
            "silver_agreement": F.col("_v.agreement"),
            "silver_votes": F.array(*[F.coalesce(F.col(v), F.lit("")) for v in votes]),
            "silver_models": F.array(*map(F.lit, models)),
        }
    ).drop("_v")


def agreement_distribution(df: DataFrame, agreement: str, domain: tuple[int, ...] = (3, 2, 1, 0)) -> DataFrame:
    """``agreement, n, share`` for each value of the domain, zeros kept."""
    spark = df.sparkSession
    levels = spark.createDataFrame([(d,) for d in domain], "agreement int")
    counts = df.groupBy(F.col(agreement).alias("agreement")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    filled = levels.join(counts, "agreement", "left").na.fill(0, ["n"]).crossJoin(F.broadcast(total))  # one row
    return filled.select("agreement", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0).alias("share"))


def inspection_rows(df: DataFrame, text: str, agreement: str) -> tuple[DataFrame, DataFrame]:
    """Rows without extraction, and rows settled by tie-break (with ``chosen``)."""
    return df.where(F.col(text).isNull()), df.where((F.col(agreement) == 1) & F.col(text).isNotNull()).withColumn("chosen", F.col(text))


def extraction_success(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``n_ok, n_failed`` by ``keys``: extractions that are there and that are null."""
    return df.groupBy(*keys).agg(F.count(text).alias("n_ok"), (F.count(F.lit(1)) - F.count(text)).alias("n_failed"))
