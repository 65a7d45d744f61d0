"""Problem 9: pages made for search engines: keywords said over and over, lists of links, tags or product lines.

A page is cut into blocks of a few lines. Each block is compressed with its links, tags, product codes and numbers masked by one
sign each, so lists of them are as redundant as repeated words; the ratio to the block's own length is divided by what
prose of the same language and length compresses to in this corpus. A block is spam if it is more redundant than that and
hardly any of it is sentences. A page is spam if more than half of its characters are in such blocks. One pass of Python over
the texts gives numbers only; the norms are small aggregates of those.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .langcrf import FUNCTION_WORDS, lexicon_codes

#: Characters of a block; a longer line is cut at white space.
BLOCK, LONG_LINE = 320, 640
#: Ratio, as a part of the norm, under which a block is redundant; share of sentences it may hold at most.
REDUNDANT, MOST_SENTENCES = 0.85, 0.5
#: Norm where the corpus has no prose of that script and length.
DEFAULT_NORM = 0.62
#: Function words from which a block names its own language; with fewer it has that of its page, or only a script.
OWN_WORDS = 2

_MARK = re.compile(r"([.!?؟]+[\"'”’»)）\]]*(?=\s|$|[|\"])|[。！？]+)")
_HAN = re.compile(r"[㐀-鿿]")
_WORD = re.compile(r"\w+")
_LINK = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,10}/\S+|\[[^\]\n]*\]\([^)\s]*\)|<a\b[^>]*>.*?</a>|(?<![\w#])#\w+", re.I)
_CODE = re.compile(r"\b[A-Z]{2,}[A-Z0-9]*-?\d[\dA-Z]*")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
# Scripts by range.
_SCRIPTS = (("latin", 0x41, 0x24F), ("cyrillic", 0x400, 0x52F), ("arabic", 0x600, 0x6FF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x3400, 0x9FFF))


def may_link(block: str) -> bool:
    return "/" in block or "#" in block or "](" in block or "<a" in block or "www." in block


def masked(block: str) -> str:
    """The block with one sign for each link, tag, product code and number."""
    if may_link(block):
        block = _LINK.sub(lambda m: "#" if m[0][0] == "#" else "u", block)
    return _NUMBER.sub("0", _CODE.sub("K", block))


@lru_cache(maxsize=1)
def _script_table() -> np.ndarray:
    table = np.zeros(0x10000, dtype=np.uint8)
    for number, (_, first, last) in enumerate(_SCRIPTS, 1):
        table[first : last + 1] = number
    return table


def script_of_block(block: str) -> str:
    """Script that most letters of the block belong to."""
    if block.isascii():
        return "latin"
    codes = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = np.bincount(_script_table()[codes[codes < 0x10000]], minlength=len(_SCRIPTS) + 1)[1:]
    return _SCRIPTS[int(counts.argmax())][0]


def function_words(block: str) -> Counter:
    """Languages of the different function words of a block."""
    return Counter(code for word in FUNCTION_WORDS.intersection(_LETTERS.findall(block.lower())) for code in lexicon_codes(word))


def languages(parts: list[str]) -> list[tuple[str, str]]:
    """``(script, language)`` of each block. A script of one language here names it; Latin needs function words."""
    scripts = [script_of_block(b) for b in parts]
    said = [function_words(b) if s == "latin" else Counter() for b, s in zip(parts, scripts, strict=True)]
    page = sum(said, Counter())
    best = lambda c: max(c, key=lambda k: (c[k], k))
    return [(s, s if s != "latin" else best(c) if c.total() >= OWN_WORDS else best(page) if page else s) for s, c in zip(scripts, said, strict=True)]


def blocks(text: str) -> list[str]:
    """The text in blocks of at least ``BLOCK`` characters (the last may be shorter); every character is in one."""
    out: list[str] = []
    held, size = [], 0
    for line in text.split("\n"):
        while len(line) > LONG_LINE:
            cut = line.rfind(" ", BLOCK, LONG_LINE)
            cut = LONG_LINE if cut < 0 else cut
            held.append(line[:cut])
            out.append("\n".join(held))
            held, size, line = [], 0, line[cut:]
        held.append(line)
        size += len(line) + 1
        if size >= BLOCK:
            out.append("\n".join(held))
            held, size = [], 0
    if held and any(h.strip() for h in held):
        rest = "\n".join(held)
        if out and len(rest) < BLOCK // 3:
            out[-1] += "\n" + rest
        else:
            out.append(rest)
    return out


def sentence_share(block: str) -> float:
    """Share of the characters in sentences: five or more words, most of them different, closed by a mark, and not said
    before in the block. Links are taken out first."""
    inside, seen = 0, set()
    parts = _MARK.split(_LINK.sub("\n", block) if may_link(block) else block)
    for piece in parts[:-1:2]:
        words = _WORD.findall(piece.lower())
        if len(words) > 70:  # no sentence: list lines that run into one, of which the last line is the sentence
            piece = piece.rsplit("\n", 1)[-1]
            words = _WORD.findall(piece.lower())
        han = _HAN.findall(piece)
        if len(han) >= 8:
            whole = len(set(han)) >= 0.6 * min(len(han), 40)
        else:
            whole = len(words) >= 5 and len(set(words)) >= (0.8 if len(words) <= 10 else 0.6) * len(words)
        said = " ".join(words)
        if whole and said not in seen:
            seen.add(said)
            inside += len(piece)
    return inside / max(1, len(block))


def block_rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc_id, script, language, bucket, n_chars, ratio, sentences)``, one row a block; null and blank texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for number, value in zip(batch["doc_id"], batch["text"], strict=True):
                if not value.strip():
                    continue
                parts = blocks(value)
                for block, (script, language) in zip(parts, languages(parts), strict=True):
                    size = max(1, len(block.encode("utf-8", "replace")))
                    ratio = len(zlib.compress(masked(block).encode("utf-8", "replace"), 6)) / size
                    bucket = size.bit_length() * 2 + (size >> max(0, size.bit_length() - 2) & 1)
                    rows.append((number, script, language, bucket, len(block), ratio, sentence_share(block)))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "script", "language", "bucket", "n_chars", "ratio", "sentences"])

    source = documents.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    return source.mapInPandas(run, "doc_id bigint, script string, language string, bucket int, n_chars bigint, ratio double, sentences double")


def page_scores(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_chars, spam_chars, spam_share)`` of every document with text."""
    measured = materialize(block_rows(documents, key, text))
    # at most languages x length buckets rows: a few hundred whatever the corpus
    prose, middle = measured.where(F.col("sentences") >= MOST_SENTENCES), F.percentile_approx("ratio", 0.5)
    by_language = F.broadcast(prose.groupBy("language", "bucket").agg(middle.alias("own_norm")))
    by_script = F.broadcast(prose.groupBy("script", "bucket").agg(middle.alias("script_norm")))
    norm = F.coalesce("own_norm", "script_norm", F.lit(DEFAULT_NORM))
    judged = measured.join(by_language, ["language", "bucket"], "left").join(by_script, ["script", "bucket"], "left").withColumn("relative", F.col("ratio") / norm)
    spam = (F.col("sentences") < MOST_SENTENCES) & (F.col("relative") < REDUNDANT)
    return (
        judged.groupBy("doc_id")
        .agg(F.sum("n_chars").alias("n_chars"), F.sum(F.when(spam, F.col("n_chars")).otherwise(0)).alias("spam_chars"))
        .withColumn("spam_share", F.col("spam_chars") / F.col("n_chars"))
    )


def spam_pages(documents: DataFrame) -> DataFrame:
    """``(doc_id)`` of the documents of which more than half is keywords, links, tags or product lines."""
    return page_scores(documents).where("spam_share > 0.5").select("doc_id")
