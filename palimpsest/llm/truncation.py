"""Problem 5: text values that were cut off.

Structure decides where it can: a think block, fence, JSON value or bracket that begins and never ends is a cut. Otherwise only a
value whose answer stops without a closing mark (or with a mark of omission) can be cut, and a self-join by prefix decides:
all distinct values are range-sorted by their letters, and a value is cut if it is a strict prefix of the value that
follows it, that is, of a longer copy elsewhere. A value that also occurs whole (as a reference, or with its closing
mark) is complete: titles and texts that lack only their last mark end here.

A value without any copy, but with finished sentences before its end or a mark of omission, is compared in parts by the same
self-join: its unfinished sentence with the sentences of whole texts, and its last words with the word sequences of whole
texts. It is cut if one of them is a strict prefix of a longer one there and never ends a sentence. Only sequences that begin
with the same words as a candidate (joined by the hash of that fixed-length prefix) are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, materialize, shuffle_width
from .answers import Answer, has_words, letters, read_answer
from .unicode_forms import skeleton

EMPTY, COMPLETE, CUT, OPEN_END = 0, 1, 2, 3
#: an open end after finished sentences or at a mark of omission: looked at in parts if no copy decides
OPEN_PART = 4
#: Words (characters of text without spaces) at the end of a value that are looked for elsewhere, and those of the hashed prefix.
TAIL_WORDS, TAIL_HAN, HEAD = 3, 5, 2

# Marks that close a sentence, and what may stand after them.
_CLOSING = ".!?。！？؟۔।：:;"
_AFTER = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u3000\u200b\"'”’“»)）]}*_`>」』"
_OMISSION = ("..", "…", "。。")
_INNER_END = re.compile(r"[.!?。！？؟][\"'”’»)）]*(?:\s|$|(?<=[。！？]))")
_SENTENCE_END = re.compile(r"[.!?؟]+[\"'”’»)）]*(?:\s+|$)|[。！？]+[”’」』）]*|\n+")
_UNIT = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")


def tail_state(answer: Answer) -> int:
    """How an answer ends: nothing there, with a closing mark, inside an open wrapper, or open."""
    if answer.unclosed:
        return CUT
    text = answer.text
    if not has_words(text):
        return EMPTY
    if text.count("(") > text.count(")") or text.count("（") > text.count("）"):
        return CUT
    body = text.rstrip(_AFTER)
    if body.endswith(_OMISSION):
        return OPEN_PART
    if body[-1:] and body[-1] in _CLOSING:
        return COMPLETE
    return OPEN_PART if _INNER_END.search(text[:-1]) else OPEN_END


def units(text: str) -> tuple[list[str], int]:
    """Words of a sentence in comparison form, characters where most of it has no spaces, and how many make a tail."""
    found = _UNIT.findall((skeleton(text) or "").casefold())
    return found, TAIL_HAN if sum("㐀" <= u[0] <= "鿿" for u in found) * 2 > len(found) else TAIL_WORDS


def last_parts(text: str) -> list[tuple[str, str]]:
    """``(head, part)`` of a text that may be cut: its unfinished sentence and its last words. ``^`` is a sentence's begin."""
    last = next((s for s in reversed(_SENTENCE_END.split(text.rstrip(_AFTER + ".…"))) if has_words(s)), "")
    words, size = units(last)
    if not words:
        return []
    out = []
    if len(words) > HEAD:
        out.append(("^" + " ".join(words[:HEAD]), "^" + "".join(words)))
    tail = [*["^"] * HEAD, *words][-size:]
    out.append((" ".join(tail[:HEAD]), "".join(tail)))
    return out


def sequences(text: str) -> Iterator[tuple[str, str, bool]]:
    """``(head, part, open)`` of a whole text: its sentences, and its word sequences one word longer than a tail; what ends a
    sentence is not open."""
    for sentence in _SENTENCE_END.split(text):
        words, size = units(sentence)
        if not words:
            continue
        if len(words) > HEAD:
            yield "^" + " ".join(words[:HEAD]), "^" + "".join(words), False
        padded = [*["^"] * HEAD, *words]
        for k in range(len(padded) - HEAD):
            head, part = " ".join(padded[k : k + HEAD]), padded[k : k + size + 1]
            if len(part) > size:
                yield head, "".join(part), True
            if len(part) <= size or k + size + 1 == len(padded):
                yield head, "".join(part), len(part) > size
            if k + size == len(padded):
                yield head, "".join(part[:size]), False


def plain_letters(text: str) -> str:
    """Letters and digits of the comparison form: equal whatever the case, spacing, marks and look-alike characters."""
    return letters(skeleton(text) or "")


PART_TYPE = "array<struct<head:string,part:string>>"


def parts_if_open(text: str, state: int) -> list[dict[str, str]] | None:
    return [{"head": h, "part": p} for h, p in last_parts(text)] if state == OPEN_PART else None


def parse(df: DataFrame, table: str, key: str, text: str, model_output: bool) -> DataFrame:
    """``(tbl, rec_id, canon, state, parts)`` of each row; a null text is the empty answer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            known: dict[str | None, tuple[str, int, list | None]] = {}
            rows = []
            for raw in batch["raw"]:
                if raw not in known:
                    answer = read_answer(raw, model_output)
                    state = tail_state(answer)
                    known[raw] = (plain_letters(answer.text), state, parts_if_open(answer.text, state))
                rows.append(known[raw])
            canon, states, parts = zip(*rows, strict=True)
            yield pd.DataFrame({"rec_id": batch["rec_id"].to_numpy(), "canon": canon, "state": states, "parts": parts})

    source = df.select(F.col(f"`{key}`").cast("bigint").alias("rec_id"), F.col(f"`{text}`").alias("raw"))
    parsed = source.mapInPandas(run, f"rec_id bigint, canon string, state int, parts {PART_TYPE}")
    return parsed.select(F.lit(table).alias("tbl"), "rec_id", "canon", "state", "parts")


def reference_letters(references: DataFrame) -> DataFrame:
    """``(canon, text)`` of a one-column frame of texts known to be whole."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if text is None else plain_letters(text) for text in batch], dtype=object, index=batch.index)

    whole = references.toDF("text").where(F.col("text").isNotNull()).distinct()
    return whole.select(F.pandas_udf(run, "string")("text").alias("canon"), "text")


def _all_sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = {x for text in batch["text"] for x in sequences(text)}
        if rows:
            yield pd.DataFrame(sorted(rows), columns=["head", "canon", "open"])


def _successors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range partition in sorted order: candidates that begin their successor (kind 0), the partition's first value
    (kind 1) and its last value if that is an undecided candidate (kind 2)."""
    number = TaskContext.get().partitionId()
    before, before_open, first = None, False, None
    for batch in batches:
        cut = []
        for canon, is_open in zip(batch["canon"], batch["open"], strict=True):
            if before is None:
                first = canon
            elif before_open and canon.startswith(before):
                cut.append(before)
            before, before_open = canon, is_open
        if cut:
            yield pd.DataFrame({"kind": 0, "number": number, "canon": cut})
    if first is not None:
        yield pd.DataFrame({"kind": [1, 2] if before_open else [1], "number": number, "canon": [first, before] if before_open else [first]})


def strict_prefixes(values: DataFrame) -> DataFrame:
    """Distinct ``canon`` of the rows with ``open`` whose letters are a strict prefix of another value's letters.

    ``values`` is ``(canon string, open boolean)``, any number of rows a value; a value that is also there with ``open``
    false is whole and never reported. Nothing is compared in pairs: after one pre-aggregated shuffle and one range sort
    each value looks at its successor. Only the first and last value of each range partition are looked at again."""
    spark = values.sparkSession
    width = shuffle_width(spark)
    single = values.where(F.coalesce(F.length("canon"), F.lit(0)) > 0).groupBy("canon").agg(F.min("open").alias("open"))
    ranged = single.repartitionByRange(width, "canon").sortWithinPartitions("canon")
    found = cut_lineage(ranged.mapInPandas(_successors, "kind int, number int, canon string"))
    # at most two rows a partition
    border = Window.orderBy("number", "kind")
    edges = found.where("kind > 0").withColumn("next", F.lead("canon").over(border))
    at_edge = edges.where("kind = 2 AND startswith(next, canon)")
    return found.where("kind = 0").select("canon").unionByName(at_edge.select("canon")).distinct()


def verdicts(parsed: DataFrame, whole: DataFrame) -> DataFrame:
    """``(tbl, rec_id, via)`` of the cut rows of ``parsed`` (see :func:`parse`, written or cheap to read twice), ``via`` being
    ``structure`` (a wrapper that never closes), ``copy`` (a strict prefix of another value) or ``part`` (no copy, but the
    unfinished sentence or the last words are a strict prefix of a sequence of a whole text).

    ``whole`` is ``(canon, text)`` of texts known to be whole. Empty tables give no rows."""
    is_open = F.col("state").isin(OPEN_END, OPEN_PART)
    values = parsed.where(F.col("state").isin(COMPLETE, OPEN_END, OPEN_PART)).select("canon", is_open.alias("open"))
    known = whole.select("canon", F.lit(False).alias("open"))
    prefixes = strict_prefixes(values.unionByName(known)).withColumn("found", F.lit("copy"))
    complete = known.select("canon").unionByName(parsed.where(F.col("state") == COMPLETE).select("canon"))
    candidates = parsed.where(is_open)
    complete = complete.join(candidates.select("canon").distinct(), "canon", "left_semi").distinct().withColumn("found", F.lit("whole"))
    judged = materialize(candidates.join(prefixes.unionByName(complete), "canon", "left").where("found is null or found = 'copy'").select("tbl", "rec_id", "state", "parts", "found"))
    # what no copy decides: its last parts against the sequences of the whole texts
    rest = judged.where(F.col("found").isNull() & (F.col("state") == OPEN_PART)).select("tbl", "rec_id", F.explode("parts").alias("p")).select("tbl", "rec_id", "p.head", F.col("p.part").alias("canon"))
    near = whole.mapInPandas(_all_sequences, "head string, canon string, open boolean").join(rest.select("head").distinct(), "head", "left_semi").select("canon", "open")
    near = materialize(near.distinct())  # the range sort reads its input twice
    going_on = strict_prefixes(near.unionByName(rest.select("canon", F.lit(True).alias("open"))))
    in_part = rest.join(going_on, "canon", "left_semi").select("tbl", "rec_id", F.lit("part").alias("via")).distinct()
    by_copy = judged.where("found = 'copy'").select("tbl", "rec_id", F.lit("copy").alias("via"))
    by_structure = parsed.where(F.col("state") == CUT).select("tbl", "rec_id", F.lit("structure").alias("via"))
    return by_copy.unionByName(by_structure).unionByName(in_part)


def judge_cut(parsed: DataFrame, whole: DataFrame) -> DataFrame:
    """``(tbl, rec_id)`` of the cut rows; repeated rows give one row. See :func:`verdicts`."""
    return verdicts(parsed, whole).select("tbl", "rec_id").distinct()


def cut_rows(benchmark: DataFrame, model_output: DataFrame, llm_result: DataFrame) -> DataFrame:
    """``(tbl, rec_id)`` of all cut values of the three tables."""
    parsed = (
        parse(benchmark, "benchmark", "idx", "translation", False)
        .unionByName(parse(model_output, "model_output", "out_id", "translation", False))
        .unionByName(parse(llm_result, "llm_result", "result_id", "raw_llm_output", True))
    )
    references = benchmark.select("reference").union(benchmark.select("source")).union(model_output.select("reference"))
    return judge_cut(materialize(parsed), materialize(reference_letters(references)))


def cut_report(rows: DataFrame, cut: DataFrame, by: Column, name: str) -> DataFrame:
    """Rows, cut rows and their share for each value of ``by``. ``rows`` is ``(rec_id, ...)`` of one table."""
    marked = rows.withColumn("origin", by).join(cut.withColumn("is_cut", F.lit(1)), "rec_id", "left")
    return (
        marked.groupBy("origin")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("is_cut"), F.lit(0)).alias("n_cut"))
        .select(F.lit(name).alias("dimension"), "origin", "n_rows", "n_cut", F.round(F.col("n_cut") / F.col("n_rows"), 6).alias("cut_share"))
    )
