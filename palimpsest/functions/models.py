"""Interfaces of external models, run in Arrow batches, with deterministic stand-ins.

A provider is made once per task by a factory, so clients and weights are never shipped. The stand-ins are no models: they
make plans testable without a network."""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import barrier


class ChatProvider(Protocol):
    def create(self, messages: list[list[dict]], max_tokens: int, **options) -> list[str]: ...


class SpanScorer(Protocol):
    def score(self, sources: list[str], spans: list[str]) -> list[float]: ...


class LanguageModel(Protocol):
    def detect(self, texts: list[str]) -> list[tuple[str | None, float]]: ...


class EchoProvider:
    """Stand-in: answers with the last line of the last message as a JSON extraction."""

    def create(self, messages: list[list[dict]], max_tokens: int, **options) -> list[str]:
        return [json.dumps({"extracted_translation": m[-1]["content"].rsplit(": ", 1)[-1], "noise_pattern": "none"}, ensure_ascii=False) for m in messages]


class PlainProvider:
    """Stand-in: answers with what the last label of the last message names, as plain text."""

    def create(self, messages: list[list[dict]], max_tokens: int, **options) -> list[str]:
        return [m[-1]["content"].rsplit(": ", 1)[-1] for m in messages]


class HttpProvider:
    """A server with the common JSON interface of chat completions. One request a row; ``options`` (temperature, thinking) go
    into the body as they are."""

    def __init__(self, url: str, model: str, key: str | None = None, timeout: float = 120.0):
        self.url, self.model, self.key, self.timeout = url, model, key, timeout

    def create(self, messages: list[list[dict]], max_tokens: int, **options) -> list[str]:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        said = []
        for asked in messages:
            body = json.dumps({"model": self.model, "messages": asked, "max_tokens": max_tokens} | options).encode()
            with urllib.request.urlopen(urllib.request.Request(self.url, body, head), timeout=self.timeout) as answer:
                said.append(json.loads(answer.read())["choices"][0]["message"]["content"] or "")
        return said


def provider_factory(kind: str, **settings) -> Callable[[], ChatProvider]:
    """Factory of a named kind of provider: ``echo``, ``plain`` or ``http``."""
    kinds = {"echo": EchoProvider, "plain": PlainProvider, "http": HttpProvider}
    if kind not in kinds:
        raise ValueError(f"no such provider: {kind}")
    return lambda: kinds[kind](**settings)


class ScriptLanguageModel:
    """Stand-in: the language of the first script found, with fixed confidences. Labels come as models write them."""

    def detect(self, texts: list[str]) -> list[tuple[str | None, float]]:
        scripts = (("[\u4e00-\u9fff]", "zh"), ("[\uac00-\ud7af]", "ko"), ("[\u0400-\u04ff]", "ru"), ("[\u0590-\u05ff]", "iw"), ("[\u0600-\u06ff]", "ar"))
        found = [next((code for pattern, code in scripts if re.search(pattern, t)), None) for t in texts]
        return [("__label__en", 0.4) if code is None else (f"__label__{code}", 0.9) for code in found]


class LengthScorer:
    """Stand-in: a span scores by how near its length is to the source's."""

    def score(self, sources: list[str], spans: list[str]) -> list[float]:
        return [min(len(a), len(b)) / max(len(a), len(b), 1) for a, b in zip(sources, spans, strict=True)]


def complete(
    df: DataFrame, messages: str, factory: Callable[[], ChatProvider], out: str = "raw_response", batch: int = 256, max_tokens: int = 1024, tries: int = 3, pause: float = 0.0, wait: float = 1.0,
    accept: Callable[[str], bool] | None = None, **options,
) -> DataFrame:
    """``df`` with ``out``, the provider's answer to each row's messages. What failed, or is not accepted, is asked again, up to
    ``tries`` times, after ``wait * 2^k`` seconds (after ``wait`` if only answers were not accepted). In the end the last answer
    is kept, accepted or not; it is null where there never was one. Write the result before using it twice: a lost task asks
    again."""
    schema = df.withColumn(out, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for frame in batches:
            answers: list[str | None] = []
            for at in range(0, len(frame), batch):
                asked = [[dict(role=m["role"], content=m["content"]) for m in row] for row in frame[messages].iloc[at : at + batch]]
                got: list[str | None] = [None] * len(asked)
                todo = list(range(len(asked)))
                for attempt in range(tries):
                    failed = False
                    try:
                        for k, text in zip(todo, provider.create([asked[k] for k in todo], max_tokens, **options), strict=True):
                            got[k] = text
                        todo = [k for k in todo if accept is not None and not accept(got[k])]
                    except Exception:  # noqa: BLE001 - whatever a provider raises
                        failed = True
                    if not todo:
                        break
                    if attempt + 1 < tries:
                        time.sleep(wait * 2**attempt if failed else wait)
                answers += got
                if pause:
                    time.sleep(pause)
            yield frame.assign(**{out: answers})

    return df.mapInPandas(run, schema)


def score_spans(df: DataFrame, source: str, span: str, factory: Callable[[], SpanScorer], out: str = "score", batch: int = 64) -> DataFrame:
    """``df`` (one row a span) with the scorer's score; the scorer is made once a task."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = factory()
        for sources, spans in batches:
            scores: list[float] = []
            for at in range(0, len(spans), batch):
                scores += scorer.score([s or "" for s in sources.iloc[at : at + batch]], list(spans.iloc[at : at + batch]))
            yield pd.Series(scores, dtype="float64", index=spans.index)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "double")(F.col(source), F.col(span)))


# Codes that language models give for languages known here by another code.
MODEL_CODES = {"iw": "he", "cmn": "zh", "zh-cn": "zh", "zh-tw": "zh", "arb": "ar"}
LABEL_PREFIX = "__label__"


def standard_code(label: str | None) -> str | None:
    """A model's label as a language code: without prefix, old and long codes mapped."""
    if label is None:
        return None
    code = label.removeprefix(LABEL_PREFIX)
    return MODEL_CODES.get(code.lower(), code)


def detect_language(df: DataFrame, text: str, factory: Callable[[], LanguageModel | None]) -> DataFrame:
    """``df`` with ``detected_lang`` and ``confidence``; null and 0.0 where there is no model or no text. A model that raises
    has no answer for that batch."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            plain = [" ".join(t.split()) if t else "" for t in batch]
            found: list[tuple[str | None, float]] = [(None, 0.0)] * len(plain)
            if model:
                try:
                    found = model.detect(plain)
                except Exception:  # noqa: BLE001 - whatever a model raises
                    pass
            yield pd.DataFrame([(standard_code(c), float(p)) if t else (None, 0.0) for t, (c, p) in zip(plain, found, strict=True)], columns=["lang", "confidence"], index=batch.index)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    told = F.pandas_udf(run, "struct<lang:string,confidence:double>")(F.col(text))
    return barrier(df, _told=told).withColumns({"detected_lang": F.col("_told.lang"), "confidence": F.col("_told.confidence")}).drop("_told")
