"""Problem 2: a consensus label per item, an agreement measure and a reliability per annotator.

A confusion model is fitted by mean field. The truth of an item is one of the labels it got; it is either a text or "there is
none". An annotator has one row of outcomes for each of the two: for a text the right text, none, or a wrong text; for none
right, or a text. Rows and class shares have Dirichlet priors; an update takes expected counts by annotator (one group-by),
expected log parameters by digamma (a column expression), and item posteriors from sums by item and label. A candidate's score
is the item's base score plus what its own supporters add, so no pairs of votes are ever made.

An item is one row with the array of its votes (at most one an annotator), sorted by label. The item side of an update is array
work over Arrow batches; each batch gives its sums by annotator, and only those are shuffled.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, materialize

ROUNDS = 8
#: Prior counts of the outcomes: for a true text (right, none, wrong), for a true none (right, text), for the class shares.
PRIOR_TEXT, PRIOR_NONE, PRIOR_CLASS = (4.0, 0.5, 1.0), (4.0, 1.0), (1.0, 1.0)
#: Most annotators whose table (a row each) is broadcast; more are joined by shuffle.
BROADCAST_ANNOTATORS = 20_000
_NO_NAME = "\x00"


def digamma(x, log=F.log):
    """Digamma of a positive column (or, with ``math.log``, number): recurrence to x + 6, then the asymptotic series."""
    y = x + 6
    series = log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6)
    for k in range(6):
        series = series - 1 / (x + k)
    return series


def same_label(text: Column) -> Column:
    """A label as it is compared: canonical composition, no outer white space; null and blank are the empty label."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else unicodedata.normalize("NFC", t).strip() for t in batch], dtype=object, index=batch.index)

    ascii_only = F.regexp_replace(text, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    composed = F.pandas_udf(run, "string")(F.when(text.rlike(r"[^\x00-\x7F]"), text))
    return F.coalesce(F.when(text.rlike(r"[^\x00-\x7F]"), composed).otherwise(ascii_only), F.lit(""))


def latest_votes(labels: DataFrame, item: str = "idx", annotator: str = "silver_model", label: str = "silver_extracted_translation") -> DataFrame:
    """``(idx, annotator, label, code, none)``: of several rows of an item and annotator the one with the latest ``run_at``
    (then ``loaded_at``, then the label). Rows without item are no votes; a null annotator is one annotator."""
    rows = labels.where(F.col(item).isNotNull()).select(
        F.col(item).cast("bigint").alias("idx"), F.coalesce(F.col(annotator), F.lit(_NO_NAME)).alias("annotator"), F.struct("run_at", "loaded_at", F.coalesce(F.col(label), F.lit("")).alias("label")).alias("v")
    )
    last = rows.groupBy("idx", "annotator").agg(F.max("v").alias("v")).select("idx", "annotator", same_label(F.col("v.label")).alias("label"))
    return last.withColumns({"code": F.xxhash64("label"), "none": F.col("label") == ""})


OUTCOMES = ("right", "missed", "wrong", "right_none", "invented", "n_votes")
LOGS = ("t_right", "t_none", "t_wrong", "n_right", "n_text")
COUNTS_TYPE = "annotator string, " + ", ".join(f"{c} double" for c in OUTCOMES)
VOTES_TYPE = "array<struct<label:string,annotator:string,code:bigint,none:boolean>>"


def gathered(votes: DataFrame) -> DataFrame:
    """``(idx, votes array<struct<label, annotator, code, none>>)``, the votes of an item in the order of label and annotator."""
    vote = F.struct("label", "annotator", "code", "none")
    return votes.groupBy("idx").agg(F.array_sort(F.collect_list(vote)).alias("votes"))


def log_parameters(right, missed, wrong, right_none, invented, log=F.log) -> list:
    """Expected log parameters (``LOGS``) of an annotator from its expected outcomes; columns or numbers."""
    a = [x + p for x, p in zip((right, missed, wrong), PRIOR_TEXT, strict=True)]
    b = [x + p for x, p in zip((right_none, invented), PRIOR_NONE, strict=True)]
    of_text, of_none = digamma(a[0] + a[1] + a[2], log), digamma(b[0] + b[1], log)
    return [digamma(x, log) - of_text for x in a] + [digamma(x, log) - of_none for x in b]


class Runs(NamedTuple):
    """The votes of a batch of items: each a vote's item and run (equal labels of an item stand together)."""

    annotator: pa.DictionaryArray
    none: np.ndarray
    item_start: np.ndarray
    item_size: np.ndarray
    run: np.ndarray
    run_start: np.ndarray
    run_size: np.ndarray
    item_of_run: np.ndarray
    first_run: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Runs:
        votes = batch.column("votes")
        size = pc.list_value_length(votes).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = votes.flatten()
        code, none = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("code", "none"))
        start = np.r_[0, np.cumsum(size)[:-1]]
        fresh = np.zeros(len(code), dtype=bool)
        fresh[start] = True
        fresh[1:] |= code[1:] != code[:-1]
        run_start = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1
        item = np.repeat(np.arange(len(size)), size)
        annotator = flat.field("annotator").dictionary_encode()
        return cls(annotator, none.astype(bool), start, size, run, run_start, np.diff(np.r_[run_start, len(code)]), item[run_start], run[start])


def _posteriors(runs: Runs, logs: np.ndarray | None, lean: float) -> np.ndarray:
    """The posterior of each run's label, from the log parameters of each vote (votes x 5), or from shares where there are none."""
    if logs is None:
        return runs.run_size / runs.item_size[runs.item_of_run]
    t_right, t_none, t_wrong, n_right, n_text = logs.T
    if_text = np.add.reduceat(np.where(runs.none, t_none, t_wrong), runs.item_start)
    if_none = np.add.reduceat(np.where(runs.none, n_right, n_text), runs.item_start) + lean
    support = np.add.reduceat(t_right - t_wrong, runs.run_start)
    score = np.where(runs.none[runs.run_start], if_none[runs.item_of_run], if_text[runs.item_of_run] + support)
    weight = np.exp(score - np.maximum.reduceat(score, runs.first_run)[runs.item_of_run])
    return weight / np.add.reduceat(weight, runs.first_run)[runs.item_of_run]


def _vote_logs(batch: pa.RecordBatch, runs: Runs, known: dict[str, tuple] | None) -> np.ndarray:
    if known is None:  # joined to the votes
        said = batch.column("logs").flatten()
        return np.stack([said.field(n).to_numpy(zero_copy_only=False) for n in LOGS], axis=1)
    table = np.array([known[a] for a in runs.annotator.dictionary.to_pylist()])
    return table[runs.annotator.indices.to_numpy(zero_copy_only=False)]


class Round(NamedTuple):
    """What an update starts from: items (with ``logs`` where there are too many annotators to ship), parameters, and lean."""

    items: DataFrame
    known: dict[str, tuple] | None
    lean: float
    first: bool

    def posteriors(self, batch: pa.RecordBatch, runs: Runs) -> np.ndarray:
        return _posteriors(runs, None if self.first else _vote_logs(batch, runs, self.known), self.lean)

    def counts(self) -> DataFrame:
        """Expected outcomes by annotator; the row of a null annotator has the expected number of items without a text and the
        number of items."""
        posteriors = self._replace(items=None).posteriors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                runs = Runs.of(batch)
                q_run = posteriors(batch, runs)
                is_none = runs.none[runs.run_start]
                none_q = np.add.reduceat(np.where(is_none, q_run, 0.0), runs.first_run)
                q, p = q_run[runs.run], none_q[runs.item_of_run][runs.run]
                who, names, text = runs.annotator.indices.to_numpy(zero_copy_only=False), runs.annotator.dictionary.to_pylist(), ~runs.none
                total = lambda x: np.bincount(who, weights=x, minlength=len(names))
                sums = [total(np.where(text, q, 0)), total(np.where(text, 0, 1 - p)), total(np.where(text, 1 - p - q, 0)), total(np.where(text, 0, q)), total(np.where(text, p, 0)), np.bincount(who, minlength=len(names)).astype(float)]
                sums = [np.r_[x, y] for x, y in zip(sums, (none_q.sum(), float(batch.num_rows), 0, 0, 0, 0), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([*names, None], pa.string()), *map(pa.array, sums)], names=["annotator", *OUTCOMES])

        parts = self.items.mapInArrow(run, COUNTS_TYPE)
        return parts.groupBy("annotator").agg(*[F.sum(c).alias(c) for c in OUTCOMES])


def _lean(with_none: float, n_items: float) -> float:
    return math.log((with_none + PRIOR_CLASS[1]) / (n_items - with_none + PRIOR_CLASS[0]))


def fit_consensus(items: DataFrame, rounds: int = ROUNDS) -> tuple[Round, DataFrame]:
    """What the last posteriors come from, and ``(annotator, expected counts of outcomes)``, after ``rounds`` updates.

    ``items`` is :func:`gathered`, written. Each round reads it once; its state is no table but the annotators' parameters: a
    row each, taken to the driver and shipped if there are at most ``BROADCAST_ANNOTATORS``, else joined to the votes."""
    now, counts = Round(items, {}, 0.0, True), items.sparkSession.createDataFrame([], COUNTS_TYPE)
    for _ in range(max(1, rounds)):
        every = now.counts()
        some = every.limit(BROADCAST_ANNOTATORS + 2).collect()
        if len(some) <= BROADCAST_ANNOTATORS + 1:
            whole = next(((r[1], r[2]) for r in some if r[0] is None), (0.0, 0.0))
            some = [tuple(r) for r in some if r[0] is not None]
            counts = items.sparkSession.createDataFrame(some, COUNTS_TYPE)
            now = Round(items, {r[0]: tuple(log_parameters(*r[1:6], log=math.log)) for r in some}, _lean(*whole), False)
        else:
            every = cut_lineage(every)
            counts = every.where("annotator is not null")
            logs = counts.select("annotator", *[c.alias(n) for c, n in zip(log_parameters(*map(F.col, OUTCOMES[:5])), LOGS, strict=True)])
            spread = items.select("idx", F.posexplode("votes").alias("at", "v")).join(logs, F.col("v.annotator") == F.col("annotator"))
            joined = spread.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("at", *LOGS))).alias("logs"))
            now = Round(items.join(joined, "idx"), None, _lean(*every.where("annotator is null").select("right", "missed").first()), False)
    return now, counts


def consensus(fitted: Round) -> DataFrame:
    """``(idx, label, posterior, n_votes, n_support, votes)``: the label with the highest posterior (then most votes, then the
    least label) of each item."""
    posteriors = fitted._replace(items=None).posteriors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = Runs.of(batch)
            q = np.round(posteriors(batch, runs), 9)
            # runs of an item are in the order of their labels; a stable sort keeps the least label first
            order = np.lexsort((-runs.run_size, -q, runs.item_of_run))
            best = order[np.flatnonzero(np.r_[True, np.diff(runs.item_of_run[order]) > 0])]
            place = (runs.run_start[best] - runs.item_start + 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("idx"), batch.column("votes"), pa.array(place), pa.array(q[best]), pa.array(runs.run_size[best].astype(np.int32))], names=["idx", "votes", "place", "posterior", "n_support"])

    made = fitted.items.mapInArrow(run, f"idx bigint, votes {VOTES_TYPE}, place int, posterior double, n_support int")
    return made.select("idx", F.element_at("votes", F.col("place"))["label"].alias("label"), "posterior", F.size("votes").alias("n_votes"), "n_support", "votes")


def dissenting_votes(labels: DataFrame) -> DataFrame:
    """``(idx, silver_model)`` of the votes whose label is not the item's consensus."""
    state, _ = fit_consensus(materialize(gathered(latest_votes(labels))))
    other = consensus(state).select("idx", F.explode(F.filter("votes", lambda v: v["label"] != F.col("label"))).alias("v"))
    return other.select("idx", F.nullif("v.annotator", F.lit(_NO_NAME)).alias("silver_model"))


def beta_quantiles(a: float, b: float, at: tuple[float, ...]) -> list[float]:
    """Quantiles of the Beta distribution, by the integral of its density on a grid that is fine where the mass is."""
    middle, spread = a / (a + b), math.sqrt(a * b / (a + b + 1)) / (a + b)
    grid = np.unique(np.clip(np.r_[np.linspace(middle - 12 * spread, middle + 12 * spread, 40_001), np.linspace(0, 1, 2_001)], 0, 1))
    inner = (grid[1:] + grid[:-1]) / 2
    log = (a - 1) * np.log(inner) + (b - 1) * np.log1p(-inner)
    mass = np.exp(log - log.max()) * np.diff(grid)
    below = np.r_[0, np.cumsum(mass)]
    return [float(np.interp(x, below / below[-1], grid)) for x in at]


def reliability(labels: DataFrame) -> DataFrame:
    """``(silver_model, n_votes, reliability, low, high, n_dissent)``: posterior mean of giving the right label, with the 95 %
    interval of its Beta posterior."""
    state, counts = fit_consensus(materialize(gathered(latest_votes(labels))))
    told = consensus(state).select("label", F.explode("votes").alias("v"))
    dissent = told.groupBy(F.col("v.annotator").alias("annotator")).agg(F.sum((F.col("v.label") != F.col("label")).cast("bigint")).alias("n_dissent"))

    def interval(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            yield pd.DataFrame([beta_quantiles(x, y, (0.025, 0.975)) for x, y in zip(a, b, strict=True)], columns=["low", "high"], index=a.index)

    right = F.col("right") + F.col("right_none") + PRIOR_TEXT[0]
    other = F.col("missed") + F.col("wrong") + F.col("invented") + PRIOR_TEXT[1] + PRIOR_TEXT[2]
    bounds = F.pandas_udf(interval, "low double, high double")(right, other)
    return counts.join(dissent, "annotator").withColumn("_b", bounds).select(
        F.nullif("annotator", F.lit(_NO_NAME)).alias("silver_model"), F.col("n_votes").cast("bigint").alias("n_votes"), (right / (right + other)).alias("reliability"), "_b.low", "_b.high", "n_dissent"
    )


def krippendorff(labels: DataFrame) -> DataFrame:
    """``(n_items, n_values, alpha)``: nominal Krippendorff agreement over items with two or more votes; alpha is null
    where nothing can disagree."""
    votes = latest_votes(labels)
    cells = votes.groupBy("idx", "code").agg(F.count(F.lit(1)).alias("n"))
    paired = cells.withColumn("m", F.sum("n").over(Window.partitionBy("idx"))).where("m > 1")
    seen = paired.agg(F.countDistinct("idx").alias("n_items"), F.sum("n").alias("total"), F.sum(F.col("n") * (F.col("m") - F.col("n")) / (F.col("m") - 1)).alias("observed"))
    spread = paired.groupBy("code").agg(F.sum("n").alias("c")).agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("squares"))
    expected = (F.col("total").cast("double") * F.col("total") - F.col("squares")) / (F.col("total") - 1)
    return seen.crossJoin(F.broadcast(spread)).select("n_items", F.col("total").alias("n_values"), F.when(expected > 0, 1 - F.col("observed") / expected).alias("alpha"))  # one row each
