"""Reading of model outputs: what is left of an output without think block, fence, JSON, lead-in and other wrappers, and
whether one of the wrappers was opened and never closed."""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from .tables import LANGUAGES


class Answer(NamedTuple):
    text: str
    #: a think block, fence or JSON value begins and never ends
    unclosed: bool
    #: the text was inside a JSON value
    from_json: bool


_THINK = re.compile(r"<(think|thinking|thought|reasoning)>", re.I)
_THINK_END = re.compile(r"</(?:think|thinking|thought|reasoning)>", re.I)
_FENCE_HEAD = re.compile(r"^(`{3,}|~{3,})[^\n`]*(?:\n|$)")
_JSON_HEAD = re.compile(r"^\{\s*[\"'“„«](\w+)[\"'”“»]\s*:\s*")
_VALUE_KEY = re.compile(r"[\"'“„«](?:extracted_translation|translation|extracted_text|text|output|answer)[\"'”“»]\s*:\s*", re.I)
_VALUE_END = re.compile(r"[\"'”“»]\s*,?\s*(?:[\"'“„«]\w+[\"'”“»]\s*:|[}\]])")
_ESCAPE = re.compile(r'\\(u[0-9a-fA-F]{4}|["\'\\/bfnrt])')
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_NAMES = "|".join(name for name, _ in LANGUAGES.values())
# Words that announce a translation before a colon.
_LEAD_WORDS = (
    r"(?:the\s+)?(?:final\s+)?(?:translation|translated\s+(?:text|version)|output|result|answer|response|traduction|traducción|tradução|traduzione|"
    r"übersetzung|tłumaczenie|překlad|перевод|翻译|译文|번역|الترجمة)"
)
_LEAD = re.compile(
    rf"^\s*[*_#>\"']*\s*(?:(?:{_NAMES})(?:\s+(?:translation|version))?|{_LEAD_WORDS}(?:\s+(?:in|into|to)?\s*\(?(?:{_NAMES})\)?)?)\s*[*_]*\s*[:：]\s*[*_]*\s*",
    re.I,
)
#: a first paragraph that ends with a colon and is short enough to be an announcement
_PREAMBLE = re.compile(r"^[^\n]{3,160}[:：][*_ ]*(?:\n[ \t]*)+(?=\S)")
_PAIRS = (("[[", "]]"), ("{{", "}}"), ("{", "}"), ("[", "]"), ("**", "**"), ('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("'", "'"), ("`", "`"))
_MARKS = re.compile(r"[\W_]+")


def has_words(text: str) -> bool:
    """True if a letter or digit is there."""
    return any(c.isalnum() for c in text)


def letters(text: str) -> str:
    """Letters and digits in folded case: what stays equal when case, spacing and marks change."""
    return _MARKS.sub("", text.casefold())


def _unescape(text: str) -> str:
    out = _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" else _ESCAPED.get(m[1], m[1]), text)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if "\\u" in text else out


def _from_json(text: str) -> tuple[str, bool] | None:
    """The value of an output that is a JSON object or looks like one, and whether the object is cut; None: no object."""
    if not text.startswith("{"):
        return None
    if text == "{}" or re.fullmatch(r"\{\s*\}", text):
        return "", False
    head = _JSON_HEAD.match(text)
    try:
        value = json.loads(text, strict=False)
    except ValueError:
        value = None
    if isinstance(value, dict):
        found = next((value[k] for k in ("extracted_translation", "translation", "extracted_text", "text", "output", "answer") if k in value), "")
        if isinstance(found, list):
            found = found[0] if found else ""
        return ("" if found is None else found if isinstance(found, str) else str(found)), False
    if head is None:
        partial = re.match(r"^\{\s*[\"']?\w{0,30}[\"']?\s*:?\s*$", text)
        return ("", True) if partial and re.match(r"^\{\s*[\"']", text) else None
    closed = text.rstrip().endswith(("}", "},", "};"))
    key = _VALUE_KEY.search(text)
    if key is None:
        return "", not closed
    rest = text[key.end() :]
    if re.match(r"(?:null|None)\b", rest):
        return "", not closed
    if rest[:1] in "\"'“„«":
        rest = rest[1:]
    ends = list(_VALUE_END.finditer(rest))
    if ends:
        cut = ends[0].start() if closed or '"noise_pattern' in rest or "'noise_pattern" in rest else ends[-1].start()
        return _unescape(rest[:cut]), not closed
    tail = re.search(r"[\"'”“»]?\s*,?\s*\}?\s*$", rest)
    return _unescape(rest[: tail.start()] if tail and closed else rest), not closed


def strip_lead_in(text: str) -> str:
    """Without a language or translation label, or an announcing first paragraph, before the text."""
    out = text
    for _ in range(2):
        shorter = _LEAD.sub("", out, count=1)
        if shorter == out:
            shorter = _PREAMBLE.sub("", out, count=1)
        if shorter == out:
            return out
        out = shorter
    return out


def strip_fence(text: str) -> tuple[str, bool]:
    """Without a fence around the whole text; the flag says that the fence never closes."""
    fence = _FENCE_HEAD.match(text)
    if fence is None:
        return text, False
    body = text[fence.end() :].rstrip()
    if body.endswith(fence[1]):
        return body[: -len(fence[1])].strip(), False
    if not body and text.count(fence[1]) == 1 and len(text) > len(fence[1]) + 12:
        return text[len(fence[1]) :].strip(), False
    return re.sub(r"\n[`~]{1,2}$", "", body).strip(), True


def strip_wrappers(text: str) -> tuple[str, bool]:
    """Without fence and paired marks around the whole text; the flag says that a fence never closes."""
    out, unclosed = text.strip(), False
    for _ in range(4):
        before = out
        if out.startswith(("```", "~~~")):
            out, cut = strip_fence(out)
            unclosed |= cut
        for opening, closing in _PAIRS:
            if len(out) >= len(opening) + len(closing) and out.startswith(opening) and out.endswith(closing):
                out = out[len(opening) : len(out) - len(closing)].strip()
                break
        if out == before:
            break
    return out, unclosed


def read_answer(raw: str | None, model_output: bool = True) -> Answer:
    """The answer in ``raw``. Null is the empty answer. ``model_output`` false: no JSON is expected."""
    if raw is None:
        return Answer("", False, False)
    text, unclosed, from_json = raw, False, False
    if "<" in text and (start := _THINK.search(text)):
        ends = list(_THINK_END.finditer(text))
        if ends:
            text = text[: start.start()] + text[ends[-1].end() :]
        else:
            return Answer(text[start.end() :].strip(), True, False)
    elif model_output and re.match(r"\s*<(?:t|th|thi|thin|think|thinking)?$", text):
        return Answer("", True, False)
    text = text.strip()
    text, open_fence = strip_fence(text) if text.startswith(("```", "~~~")) else (text, False)
    if model_output and (read := _from_json(text)) is not None:
        text, cut = read
        unclosed, from_json = cut or open_fence, True
    else:
        unclosed = open_fence
    text = text.strip()
    text, open_inner = strip_wrappers(text)
    text = strip_lead_in(text)
    text, _ = strip_wrappers(text)
    return Answer(text.strip(), unclosed or open_inner, from_json)
