"""Reading of model responses. JSON is read as Python's ``json`` reads it, which no Spark function does; only texts that can
hold an object visit Python."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

KEY = "extracted_translation"
RESULT_TYPE = "struct<extracted:string,noise_pattern:string>"
# The patterns and, in the readers below, the order they are tried in.
_FENCED = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.S)
_FOLLOWED = re.compile(rf'"{KEY}"\s*:\s*"((?:[^"\\]|\\.)*)"\s*[,\n]?\s*"noise_pattern', re.S)
_OTHER_QUOTES = re.compile(rf'"{KEY}"\s*:\s*["„“«](.*?)["”“»]\s*[,\n]?\s*"noise_pattern', re.S)
_TO_NEXT_LINE = re.compile(rf'"{KEY}"\s*:\s*(.+?),?\s*\n\s*"noise_pattern', re.S)
_PATTERN = re.compile(r'"noise_pattern"\s*:\s*"([^"]*)"')
_EMBEDDED = re.compile(rf'\{{[^{{}}]*"{KEY}"[^{{}}]*\}}', re.S)
_QUOTES = '"„“”«»'
_THINK_BLOCK = re.compile(r"<think>.*?</think>", re.S)
_THINK_LEAD = re.compile(r"^(thinking|reasoning|analysis):?\s*\n.*?\n\n(?=\{)", re.S | re.I)
_THINKING_HEAD = re.compile(r"(?:Thinking Process|思考过程|Thought Process|My Thinking)[:\s]", re.I)


def _load(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _value(found: object) -> str | None:
    """A field's value as text: the first of a list, null for nothing."""
    if isinstance(found, list):
        found = found[0] if found else None
    return None if found is None else found if isinstance(found, str) else str(found)


def read_result(text: str | None) -> tuple[str | None, str | None]:
    """Extracted text and noise pattern of a stored result: fenced object, object, then repairs of broken objects; a text
    with no such field is the extraction itself."""
    if text is None:
        return None, None
    fenced = _FENCED.search(text)
    parsed = _load(fenced[1]) if fenced else None
    if not isinstance(parsed, dict):
        parsed = _load(text)
    if isinstance(parsed, dict):
        pattern = _value(parsed.get("noise_pattern"))
        return (_value(parsed[KEY]) if KEY in parsed else text), pattern
    found = _FOLLOWED.search(text) or _OTHER_QUOTES.search(text)
    extracted = found[1].strip() if found else None
    if found is None and (rest := _TO_NEXT_LINE.search(text)):
        extracted = rest[1].strip().strip(_QUOTES).strip()
    pattern = _PATTERN.search(text)
    return (text if extracted is None else extracted), pattern[1] if pattern else None


def read_silver(text: str | None) -> tuple[str | None, str | None]:
    """Extraction of an annotator's response; null where there is no object with the field."""
    if text is None:
        return None, None
    bare = _THINK_BLOCK.sub("", text).strip()
    bare = _THINK_LEAD.sub("", bare).strip()
    fenced, embedded = _FENCED.search(bare), _EMBEDDED.search(bare)
    for candidate in (fenced[1] if fenced else None, bare, embedded[0] if embedded else None):
        parsed = _load(candidate) if candidate is not None else None
        if isinstance(parsed, dict) and KEY in parsed:
            return _value(parsed[KEY]), _value(parsed.get("noise_pattern"))
    return None, None


def read_extractor(text: str | None) -> tuple[str | None, str | None]:
    """Extraction and noise pattern of an extractor's raw output: the part after a think block, the last paragraph after a
    thinking header, the fields of an object if it is one; a blank extraction keeps the object's text."""
    if text is None:
        return None, None
    out = text.strip()
    if (end := re.search(r"</think>\s*", out)) is not None:
        out = out[end.end() :].strip()
    if _THINKING_HEAD.match(out):
        out = next((p.strip() for p in reversed(re.split(r"\n\s*\n", out)) if p.strip()), "")
    parsed = _load(out)
    if not isinstance(parsed, dict):
        return out, None
    return ((_value(parsed.get(KEY)) or "").strip() or out), _value(parsed.get("noise_pattern"))


def _udf(reader: Callable[[str | None], tuple[str | None, str | None]]) -> Callable[[Column], Column]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([reader(t) for t in batch], columns=["extracted", "noise_pattern"], index=batch.index)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, RESULT_TYPE)


def parse_result(text: Column) -> Column:
    """``struct(extracted, noise_pattern)`` of a stored extraction (see :func:`read_result`)."""
    may = text.contains("{") | text.contains(f'"{KEY}"') | text.contains('"noise_pattern"')
    plain = F.struct(text.alias("extracted"), F.lit(None).cast("string").alias("noise_pattern"))
    return F.when(may, _udf(read_result)(F.when(may, text))).otherwise(plain)


def parse_silver(text: Column) -> Column:
    """Extraction of an annotator's response, null if there is none."""
    return F.when(text.contains("{"), _udf(read_silver)(F.when(text.contains("{"), text))["extracted"])


def parse_extractor(text: Column, translation: Column) -> Column:
    """``struct(extracted_text, predicted_noise_pattern, coverage, raw_llm_output)`` of an extractor's output."""
    read = _udf(read_extractor)(text)
    whole = F.length(strip(F.coalesce(translation, F.lit(""))))
    share = F.when(whole > 0, F.length(read["extracted"]) / whole).otherwise(1.0)
    return F.struct(read["extracted"].alias("extracted_text"), read["noise_pattern"].alias("predicted_noise_pattern"), share.alias("coverage"), strip(text).alias("raw_llm_output"))
