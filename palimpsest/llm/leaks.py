"""Problem 7: passages of held-out items inside a corpus.

The held-out items (a few hundred, the same number at every scale; the bound is checked) are turned into an index of
character q-grams that every task gets; the corpus is read once, in place, without a shuffle. Per document the q-grams
shared with an item are counted in overlapping diagonal bands. By the q-gram lemma a passage that meets the edit budget
leaves at least a known number of shared q-grams in one band, so only regions with that many are kept. A kept region is
verified by banded alignment: from each run of equal letters on a diagonal of the band the alignment goes on to both sides by
whole words (characters of Chinese), with replaced, missing or added ones as edits, so it may leave the diagonal by a few words.
Letters are aligned, not words: it does not matter where either text has its spaces or hyphens.

Texts are compared by letters and digits in folded case, without accents, with look-alike letters mapped together, so
case, punctuation, spacing, line breaks, markup and quote marks do not matter.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .unicode_forms import caseless, stable_form

#: Exact run of words (characters for text without spaces), and the length from which one unit in ten may be replaced.
EXACT_WORDS, LOOSE_WORDS = 12, 15
EXACT_HAN, LOOSE_HAN = 24, 30
#: Lengths of q-grams; an item takes the longest that its shortest guaranteed run allows.
Q_WORDS, Q_HAN = (20, 16, 12, 9), 5
#: Fewest q-grams of Chinese within the budget: an edit spoils at most q of them, and with ten more characters an edit comes in.
LEAST_HAN = min(EXACT_HAN - Q_HAN + 1, LOOSE_HAN - Q_HAN + 1 - Q_HAN * (LOOSE_HAN // 10))
BAND = 64
#: Most held-out items, and letters of them, that a broadcast index is built of; more are answered in as many passes as needed.
ITEMS_A_PASS, LETTERS_A_PASS = 5000, 8_000_000
#: Letters handled at once in a task (memory of the task; texts are never cut).
CHUNK = 1_500_000

_SPACE = 1
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1B54A32D192ED03  # odd, so it has an inverse modulo 2**64
_BITS = 20
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """For each code point of the basic plane its comparison code: 0 nothing, 1 word gap, else a letter or digit."""
    table = np.zeros(0x10000, dtype=np.uint32)
    for code in range(0x10000):
        char = chr(code)
        if char.isspace() or char in "/|–—→\x00":
            table[code] = _SPACE
        elif char.isalnum():
            if code < 0x2E80 or 0xFF00 <= code:
                folded = unicodedata.normalize("NFKD", caseless(char))[0]
                table[code] = ord(caseless(folded)[0])
            else:
                table[code] = code
    return table


class Stream(NamedTuple):
    """Texts as one run of letters: code, text number and word number of each letter, and the prefix hash."""

    letters: np.ndarray
    text: np.ndarray
    word: np.ndarray
    first: np.ndarray
    prefix: np.ndarray


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _plain(text: str) -> str:
    if "&" in text and ";" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return (stable_form(text) or "").replace("ß", "ss").replace("ẞ", "SS")


def stream(texts: list[str]) -> Stream:
    codes = np.frombuffer("\0".join(map(_plain, texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) if texts else np.zeros(0, dtype=np.uint32)
    table = _folding()
    folded = np.where(codes < 0x10000, table[np.minimum(codes, 0xFFFF)], np.where((codes >= 0x20000) & (codes < 0x32000), codes, 0))
    keep = folded > _SPACE
    gaps = np.cumsum(folded == _SPACE, dtype=np.int64)[keep]
    text = np.cumsum(codes == 0, dtype=np.int64)[keep]
    letters = folded[keep].astype(np.uint64)
    n = len(letters)
    starts = np.ones(n, dtype=bool)
    starts[1:] = gaps[1:] != gaps[:-1]
    word = np.cumsum(starts) - 1
    up, _ = _powers(_room(n))
    mixed = letters * _MULTIPLIER
    mixed ^= mixed >> np.uint64(29)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mixed * up[:n], out=prefix[1:])
    return Stream(letters, text, word, np.searchsorted(text, np.arange(len(texts) + 1)), prefix)


def _room(n: int) -> int:
    return max(1 << 16, 1 << int(n).bit_length())


def grams(s: Stream, q: int) -> np.ndarray:
    """Hash of the q-gram at each letter that has one (also across texts; see ``inside``)."""
    n = len(s.letters) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    _, down = _powers(_room(len(s.letters)))
    return _stir((s.prefix[q : q + n] - s.prefix[:n]) * down[:n])


def _stir(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    return h * _MULTIPLIER


class Letters(NamedTuple):
    """One text as it is aligned: codes, the same as a string, and the places where words begin, with the end."""

    codes: np.ndarray
    text: str
    bounds: list[int]


def letters_of(s: Stream, number: int) -> Letters:
    first, last = s.first[number], s.first[number + 1]
    codes, word = s.letters[first:last], s.word[first:last]
    bounds = [*np.flatnonzero(np.r_[True, word[1:] != word[:-1]]).tolist(), last - first] if len(word) else [0]
    return Letters(codes, codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), bounds)


class Part(NamedTuple):
    """The q-gram index of the items of one length of q-gram."""

    q: int
    han: bool
    hashes: np.ndarray
    start: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray


class Index(NamedTuple):
    ids: list[int]
    items: list[Letters]
    threshold: np.ndarray
    parts: list[Part]


def _least_hits(sizes: list[int], q: int, exact: int, loose: int) -> int:
    """Fewest q-grams that a passage within the budget can share with the item, over all passages of the item."""
    least = 1 << 30
    n = len(sizes)
    total = np.r_[0, np.cumsum(sizes)]
    for i in range(max(1, n - exact + 1)):
        least = min(least, int(total[min(n, i + exact)] - total[i]) - q + 1)
    for i in range(n - loose + 1):
        for hole in range(i + 1, i + loose - 1):
            runs = int(total[hole] - total[i]), int(total[i + loose] - total[hole + 1])
            least = min(least, sum(max(0, r - q + 1) for r in runs))
    for i in range(n - 20 + 1):  # two replaced of twenty: the two longest words lost, three runs
        least = min(least, int(total[i + 20] - total[i]) - sum(sorted(sizes[i : i + 20])[-2:]) - 3 * (q - 1))
    return least


def build_index(items: list[tuple[int, str]]) -> Index:
    """Index of ``(item_id, text)``; items without the words of a passage are in it and never found."""
    texts = [text for _, text in items]
    s = stream(texts)
    by_q: dict[tuple[int, bool], list[int]] = {}
    aligned = [letters_of(s, k) for k in range(len(items))]
    threshold = np.ones(len(items), dtype=np.int64)
    for k in range(len(items)):
        letters = aligned[k].codes
        han = bool(len(letters)) and float(((letters >= 0x3400) & (letters <= 0x9FFF)).mean()) > 0.5
        if han:
            by_q.setdefault((Q_HAN, True), []).append(k)
            threshold[k] = LEAST_HAN
            continue
        sizes = np.diff(aligned[k].bounds).tolist()
        for q in Q_WORDS:
            least = _least_hits(sizes, q, EXACT_WORDS, LOOSE_WORDS) if len(sizes) >= EXACT_WORDS else 1
            if least >= 8 or q == Q_WORDS[-1]:
                break
        threshold[k] = max(1, least)
        by_q.setdefault((q, False), []).append(k)
    parts = []
    for (q, han), members in sorted(by_q.items()):
        h, every = grams(s, q), []
        for k in members:
            places = np.arange(s.first[k], max(s.first[k], s.first[k + 1] - q + 1))
            every.append((h[places], np.full(len(places), k), places - s.first[k]))
        hashes, item, place = (np.concatenate(x) for x in zip(*every, strict=True))
        order = np.argsort(hashes, kind="stable")
        unique, start = np.unique(hashes[order], return_index=True)
        bitmap = np.zeros(1 << _BITS, dtype=bool)
        bitmap[(unique >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        parts.append(Part(q, han, unique, np.r_[start, len(order)], item[order], place[order], bitmap))
    return Index([i for i, _ in items], aligned, threshold, parts)


def _runs(left: np.ndarray, right: np.ndarray, d: int, least: int) -> list[tuple[int, int]]:
    """Runs of at least ``least`` equal letters on diagonal ``d``, as places of ``right``."""
    a, b = max(0, d), max(0, -d)
    size = min(len(left) - a, len(right) - b)
    if size < least:
        return []
    edges = np.flatnonzero(np.diff(np.r_[False, left[a : a + size] == right[b : b + size], False]))
    long = edges[1::2] - edges[::2] >= least
    return list(zip((edges[::2][long] + b).tolist(), (edges[1::2][long] + b).tolist(), strict=True))


def _reach_words(doc: Letters, item: Letters, i: int, p: int, ahead: bool, most: int) -> list[int]:
    """Words of the item that an alignment from its word bound ``i`` and the document's letter ``p`` gets through with 0, 1, ...
    ``most`` words replaced, missing or added. It ends where both have a word bound."""
    n, out = len(item.bounds) - 1, []
    states = {(i, p)}
    for edits in range(most + 1):
        if edits:
            grown = set()
            for k, at in states:
                spot = bisect_left(doc.bounds, at) + (1 if ahead else -1)
                more, j = (k < n if ahead else k > 0), k + (1 if ahead else -1)
                if more:
                    grown.add((j, at))
                if 0 <= spot < len(doc.bounds):
                    grown.add((k, doc.bounds[spot]))
                    if more:
                        grown.add((j, doc.bounds[spot]))
            states = grown
        slid = set()
        for k, at in states:
            kept = (k, at)
            while k < n if ahead else k > 0:
                first, last = (item.bounds[k], item.bounds[k + 1]) if ahead else (item.bounds[k - 1], item.bounds[k])
                word = item.text[first:last]
                if not (doc.text.startswith(word, at) if ahead else at >= len(word) and doc.text.startswith(word, at - len(word))):
                    break
                k, at = (k + 1, at + len(word)) if ahead else (k - 1, at - len(word))
                spot = bisect_left(doc.bounds, at)
                if spot < len(doc.bounds) and doc.bounds[spot] == at:
                    kept = (k, at)
            slid.add(kept)
        states = slid
        out.append(max((abs(k - i) for k, _ in states), default=0))
    return out


def _holds_words(doc: Letters, item: Letters, d: int, q: int) -> bool:
    """A passage within the edit budget that has a q-gram on letter diagonal ``d``. A longer passage has a part of under two
    ``LOOSE_WORDS`` that is within the budget, so more edits than that part may have need no look."""
    most = 2 * LOOSE_WORDS // 10 - 1
    for first, last in _runs(doc.codes, item.codes, d, q):
        k, m = bisect_left(item.bounds, first), bisect_right(item.bounds, last) - 1
        at_bound = lambda x: (y := bisect_left(doc.bounds, item.bounds[x] + d)) < len(doc.bounds) and doc.bounds[y] == item.bounds[x] + d
        while k < m and not at_bound(k):
            k += 1
        while k < m and not at_bound(m):
            m -= 1
        if m - k >= EXACT_WORDS:
            return True
        if m > k:
            back = _reach_words(doc, item, k, item.bounds[k] + d, False, most)
            ahead = _reach_words(doc, item, m, item.bounds[m] + d, True, most)
            if any(m - k + back[x] + ahead[y] >= max(LOOSE_WORDS, 10 * (x + y)) for x in range(most + 1) for y in range(most + 1 - x)):
                return True
    return False


def _reach(left: list, right: list, most: int) -> list[int]:
    """Characters of ``right`` that an alignment from the start of both gets through with 0, 1, ... ``most`` edits."""
    far: dict[int, int] = {}
    out = []
    for edits in range(most + 1):
        new: dict[int, int] = {}
        for k in range(-edits, edits + 1):
            j = 0 if not edits else max(far.get(k, -9) + 1, far.get(k - 1, -9), far.get(k + 1, -9) + 1)
            j = min(j, len(right), len(left) - k)
            if j < 0 or j + k < 0:
                continue
            while j < len(right) and j + k < len(left) and left[j + k] == right[j]:
                j += 1
            new[k] = j
        far = new
        out.append(max(far.values()))
    return out


def _holds_han(left: np.ndarray, right: np.ndarray, d: int) -> bool:
    """The same for Chinese: a run of ``EXACT_HAN`` characters, or a passage within the edit budget that has a q-gram on
    diagonal ``d``, also if a word was replaced by one of another length."""
    most, room = 2 * LOOSE_HAN // 10 - 1, 3 * LOOSE_HAN
    for first, last in _runs(left, right, d, Q_HAN):
        if last - first >= EXACT_HAN:
            return True
        back = _reach(left[max(0, first + d - room) : first + d][::-1].tolist(), right[max(0, first - room) : first][::-1].tolist(), most)
        ahead = _reach(left[last + d : last + d + room].tolist(), right[last : last + room].tolist(), most)
        if any(last - first + back[x] + ahead[y] >= max(LOOSE_HAN, 10 * (x + y)) for x in range(most + 1) for y in range(most + 1 - x)):
            return True
    return False


def find(index: Index, texts: list[str]) -> list[tuple[int, int]]:
    """``(text number, item number)`` of every text that has a passage of an item."""
    s = stream(texts)
    out: set[tuple[int, int]] = set()
    read: dict[int, Letters] = {}
    for part in index.parts:
        h = grams(s, part.q)
        if not len(h):
            continue
        at = np.flatnonzero(part.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = at[s.text[at] == s.text[at + part.q - 1]]
        slot = np.searchsorted(part.hashes, h[at])
        slot[slot == len(part.hashes)] = 0
        real = part.hashes[slot] == h[at]
        at, slot = at[real], slot[real]
        if not len(at):
            continue
        count = part.start[slot + 1] - part.start[slot]
        posting = np.repeat(part.start[slot] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        place, item = np.repeat(at, count), part.item[posting]
        text = s.text[place]
        local = place - s.first[text]
        pair = text * len(index.ids) + item
        # a pair with too few shared q-grams in all has no band with enough
        enough = np.bincount(pair)[pair] >= index.threshold[item]
        if not enough.any():
            continue
        place, item, posting, text, local, pair = (x[enough] for x in (place, item, posting, text, local, pair))
        diagonal = local - part.place[posting] + (1 << 20)
        kept = np.zeros(len(pair), dtype=bool)
        for shift in (0, BAND // 2):
            key = pair * (1 << 17) + (diagonal + shift) // BAND
            _, inverse, hits = np.unique(key, return_inverse=True, return_counts=True)
            kept |= hits[inverse] >= index.threshold[item]
        if not kept.any():
            continue
        pair, text, item, place, spot = pair[kept], text[kept], item[kept], place[kept], part.place[posting][kept]
        line = (place - s.first[text]) - spot
        for k in np.unique(np.stack([pair, line]), axis=1).T:
            number, which = divmod(int(k[0]), len(index.ids))
            if (number, which) in out:
                continue
            doc = read.get(number)
            if doc is None:
                doc = read[number] = letters_of(s, number)
            item = index.items[which]
            if _holds_han(doc.codes, item.codes, int(k[1])) if part.han else _holds_words(doc, item, int(k[1]), part.q):
                out.add((number, which))
    return sorted(out)


def leaked(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id)`` of every document with a passage of an item. Null and blank texts hold and are no passage;
    repeated rows give one row. Items are collected in passes of at most about ``ITEMS_A_PASS`` items and ``LETTERS_A_PASS``
    characters, so the broadcast has a fixed bound."""
    spark = documents.sparkSession
    held = items.select(F.col(f"`{item_key}`").cast("bigint").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t is not null and i is not null").distinct()
    total = held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("letters")).first()
    passes = max(1, -(-total["n"] // ITEMS_A_PASS), -(-total["letters"] // LETTERS_A_PASS))
    source = documents.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    result = None
    for number in range(passes):
        mine = held if passes == 1 else held.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == number)
        shared = spark.sparkContext.broadcast(build_index(sorted((r.i, r.t) for r in mine.collect())))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for batch in batches:
                ids, texts = batch["doc_id"].to_numpy(), batch["text"].tolist()
                at = 0
                while at < len(texts):
                    end, size = at, 0
                    while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                        size += len(texts[end]) + 1
                        end += 1
                    pairs = find(index, texts[at:end]) if index.ids else []
                    if pairs:
                        yield pd.DataFrame({"doc_id": [int(ids[at + d]) for d, _ in pairs], "item_id": [index.ids[i] for _, i in pairs]}, dtype="int64")
                    at = end

        found = source.mapInPandas(run, "doc_id bigint, item_id bigint")
        result = found if result is None else result.unionByName(found)
    return result.distinct()
