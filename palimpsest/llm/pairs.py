"""Problem 3: prompt and response pairs that are of no use, with the kind of defect.

A response is first read (:mod:`.answers`). Copies are found by aligning it with the prompt: five-word shingles contained both
ways (where spaces differ or words are few, shingles of five letters), then the longest common subsequence. Refusals are found
by aligning the whole response with templates: a template's words in their order, and most other words from the vocabulary
of refusals. A response cut off is judged by :mod:`.truncation`, one in another language by :mod:`.langcrf`. One defect a
pair, in the order ``empty``, ``refusal``, ``truncated``, ``copied_source``, ``other_language``.

The chain labels only responses whose words, each looked at alone, give the target less than ``ALONE`` on the mean; the README
has what that misses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .answers import has_words, letters, read_answer
from .langcrf import FUNCTION_WORDS, LABELS, Model, bare_words, has_han, passages, tokens
from .tables import target_of_pair
from .truncation import COMPLETE, EMPTY, PART_TYPE, judge_cut, parts_if_open, reference_letters, tail_state
from .unicode_forms import skeleton

#: Words of a shingle and the least similarity of a copy.
SHINGLE, LEAST_SHINGLES, LEAST_COMMON = 5, 0.8, 0.95
#: Share of the words of a refusal (letters of text without spaces) that templates and vocabulary must cover.
REFUSAL_COVER = 0.6
#: Mean probability of the target from which words alone settle that a response is not foreign.
ALONE = 0.4

# Refusal templates. Each is a sequence of word choices that must occur in this order; ``*`` ends a stem.
REFUSALS = (
    "cannot|can't|can’t|unable|won't|couldn't translat*|help|assist|process|provid*|comply|fulfil*|answer|continue|render|complete|handle",
    "not able|allowed|permitted|possible|willing|going|comfortable to translat*|help|assist|process|provid*|comply|answer|render|handle",
    "can|could|will|do|would|must|may|rather|prefer not|never translat*|help|assist|process|provid*|comply|answer|render|handle|share",
    "must|have|need|going|obliged decline|refuse",
    "i|we decline|refuse to",
    "no translat*|answer|response will|can|is be given|provided|made|possible|available|offered",
    "outside|beyond|against of|my|the|what allowed|scope|permitted|able|guidelines|policy|policies|rules|abilities",
    "ne|n'ai|n'est peux|puis|pouvons|suis|saurais|souhaite|est pas traduire|aider|fournir|répondre|traiter|possible|mesure",
    "impossible de traduire|répondre|fournir",
    "kann|können|darf|dürfen|möchte|werde nicht|keine|kein übersetz*|helfen|bearbeiten|antworten|liefern|weiterhelfen|anfertigen",
    "nicht in der lage",
    "no puedo|podemos|es|estoy|puede traducir|ayudar*|proporcionar|responder|posible|procesar|autorizado",
    "non posso|possiamo|sono|è|riesco tradurre|aiutar*|fornire|rispondere|possibile|elaborare|grado",
    "não posso|podemos|consigo|é|estou traduzir|ajudar*|fornecer|responder|possível|processar|autorizado",
    "nie mogę|możemy|jestem|da|jest przetłumaczyć|tłumaczyć|pomóc|odpowiedzieć|przetworzyć|stanie|możliwe|się",
    "nemohu|nemůžu|nemůžeme|nelze|nesmím|nejsem přeložit|překládat|pomoci|pomoct|odpovědět|zpracovat|schopen",
    "не|невозможно могу|можем|в|буду|имею|удастся|получится|перевести|переводить перевести|переводить|помочь|ответить|обработать|состоянии|права|этот|текст",
    "لا|لن أستطيع|يمكنني|يمكن|أقدر|نستطيع ترجمة|ترجمته|أترجم|مساعد*|تقديم|الإجابة|معالجة|أن",
    "عذرا|آسف|أعتذر لا|لن ترجمة|أترجم|مساعد*|أستطيع|يمكنني",
)
# The same for text without spaces between words, and for agglutinated words: pieces in order.
REFUSAL_PIECES = (
    ("无法|不能|没办法|拒绝|不便|不会", "翻译|提供|帮助|处理|回答|协助|完成"),
    ("抱歉|对不起|很遗憾", "无法|不能|没办法|不便"),
    ("번역|도와|도움|제공|처리|답변", "수 없|수가 없|못|어렵|불가"),
    ("죄송|미안", "수 없|수가 없|못|어렵|불가"),
)
# What else a refusal speaks of. ``*`` ends a stem. Function words are those of the language lexicons.
REFUSAL_WORDS = """
    sorry apolog* unfortunately regret* afraid language model assistant ai translat* text* passage* content request* message sentence* material document* input
    provided supplied given giv* submitted this another different else something anything instead other* need* want* like happy glad please try send share ask question* help assist*
    support process* provid* comply continue fulfil* answer* respond response* decline* refus* rather allowed permitted able unable cannot possible willing comfortable
    break violat* against rule* usage policy policies guideline* terms copyright* right* subject protect* harmful sensitive inappropriate offensive unsafe private personal
    reason* contain* includ* may might because since due outside beyond falls scope abilities
    désolé* regrette malheureusement traduire traduction texte* passage contenu demande phrase aide* répondre fournir autre* veuillez essayer modèle langage règles droits
    leid entschuldig* leider bedauer* text* übersetz* inhalt* anfrage abschnitt sprachmodell hilfe helfen bitte ander* versuchen richtlinien regeln
    siento lamento desafortunadamente traducir traducción texto* contenido solicitud pasaje ayudar* modelo lenguaje otro otra favor intente normas
    dispiace purtroppo tradurre traduzione testo* contenuto richiesta brano aiutar* modello linguistico altro altra favore provi regole
    desculp* lamento infelizmente traduzir tradução texto* conteúdo pedido trecho ajudar* modelo linguagem outro outra favor tente regras
    przykro przepraszam niestety przetłumaczyć tłumaczyć tłumaczenia tekst* treść treści fragment* prośb* pomóc model językowy inny innego proszę spróbuj zasady
    omlouvám bohužel lituji přeložit překládat překlad* text* obsah* žádost* úryvek pomoci pomoct model jazykový jiný jiného prosím zkuste pravidla
    сожалению извините простите жаль перевести переводить перевод текст* содержание запрос* отрывок помочь модель языковая другой другое пожалуйста попробуйте правила
    عذرا آسف أعتذر للأسف ترجمة ترجمته أترجم النص المحتوى الطلب المقطع مساعدة مساعدتك آخر يرجى نموذج لغوي
    죄송* 미안* 글* 글은 텍스트* 문장* 내용* 요청* 번역* 도와* 도움* 제공* 처리* 답변* 없* 못* 어렵* 불가* 다른* 언어 모델*
"""
REFUSAL_HAN = "很抱歉|抱歉|对不起|很遗憾|遗憾|无法|不能|没办法|拒绝|不便|不会|翻译|提供|帮助|处理|回答|协助|完成|这段|该段|文字|文本|内容|请求|请|换|一段|其他|作为|语言模型|人工智能|您|你|我|的|这|为|给|因为|可能|违反|规定|规则|版权"


def _choices(part: str) -> tuple[frozenset[str], tuple[str, ...]]:
    """The words and the stems of a template's part."""
    words = part.split("|")
    return frozenset(w for w in words if not w.endswith("*")), tuple(w[:-1] for w in words if w.endswith("*"))


Template = list[tuple[frozenset[str], tuple[str, ...]]]
_TEMPLATES: list[Template] = [[_choices(part) for part in line.split()] for line in REFUSALS]
#: Templates by each word they can begin with; a template begins with a whole word.
_BY_FIRST: dict[str, list[Template]] = {}
for _template in _TEMPLATES:
    for _word in _template[0][0]:
        _BY_FIRST.setdefault(_word, []).append(_template)
_PIECES = [[choice.split("|") for choice in line] for line in REFUSAL_PIECES]
_ROUGH = {w for w in REFUSAL_WORDS.split() if not w.endswith("*")}
_STEMS = tuple(w[:-1] for w in REFUSAL_WORDS.split() if w.endswith("*"))
_HAN_PIECE = re.compile("|".join(sorted(REFUSAL_HAN.split("|"), key=len, reverse=True)))


def aligned(words: list[str], start: int, template: Template, slack: int = 6) -> list[int]:
    """Places of the words that the template is aligned with from ``start`` on, in order and with at most ``slack`` words between
    parts; none if it cannot be."""
    places = [start]
    for whole, stems in template[1:]:
        at = places[-1]
        for k in range(at + 1, min(len(words), at + 2 + slack)):
            if words[k] in whole or (stems and words[k].startswith(stems)):
                places.append(k)
                break
        else:
            return []
    return places


@lru_cache(maxsize=65536)
def _spoken(word: str) -> int:
    """1 for a word of the vocabulary of refusals, 0 for a function word, -1 for any other."""
    if word in _ROUGH or word.startswith(_STEMS):
        return 1
    return 0 if word in FUNCTION_WORDS else -1


def is_refusal(text: str, words: list[str]) -> bool:
    """``text`` declines to answer and does nothing else: a template can be aligned with it, and template and vocabulary cover
    most of its words that are no function words, whatever its length."""
    places = {k for start, w in enumerate(words) if w in _BY_FIRST for t in _BY_FIRST[w] for k in aligned(words, start, t)}
    if places:
        spoken = [1 if k in places else _spoken(w) for k, w in enumerate(words)]
        if spoken.count(1) >= REFUSAL_COVER * (spoken.count(1) + spoken.count(-1)):
            return True
    if text.isascii():
        return False
    for parts in _PIECES:
        at = 0
        for choices in parts:
            ends = [p + len(c) for c in choices if (p := text.find(c, at)) >= 0]
            if not ends:
                break
            at = min(ends)
        else:
            if has_han(parts[0][0]):
                cover, size = sum(len(m) for m in _HAN_PIECE.findall(text)), sum(c.isalnum() for c in text)
            else:
                spoken = [_spoken(w) for w in words]
                cover, size = spoken.count(1), spoken.count(1) + spoken.count(-1)
            if cover >= REFUSAL_COVER * size:
                return True
    return False


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence; row-wise numpy, so whole texts of any length are compared."""
    number = {w: i for i, w in enumerate(dict.fromkeys(b))}
    right = np.array([number[w] for w in b])
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for w in a:
        same = right == number.get(w, -1)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(same, row[:-1] + 1, 0)))
    return int(row[-1])


class Reading(NamedTuple):
    """A text as it is compared: its letters in skeleton form, and its words."""

    plain: str
    words: list[str]

    @classmethod
    def of(cls, text: str) -> Reading:
        return cls(letters(skeleton(text) or ""), bare_words(text))


def _shingles(sequence: list[str] | str) -> set:
    return {tuple(sequence[i : i + SHINGLE]) for i in range(max(1, len(sequence) - SHINGLE + 1))}


def _contained(a: list[str] | str, b: list[str] | str) -> bool:
    """Shingles of each are contained in the other to the least share."""
    left, right = _shingles(a), _shingles(b)
    return len(left & right) >= LEAST_SHINGLES * max(len(left), len(right))


def is_copy(answer: Reading, prompt: Reading) -> bool:
    """The answer is the prompt and nothing else, whatever the case, spacing, characters or marks.

    Words are aligned where there are enough of them; else, or where they are parted otherwise, letters are, and then all
    letters must align. The tests before the alignment are necessary for it, so they lose nothing."""
    a, b = answer.plain, prompt.plain
    if not a or not b or abs(len(a) - len(b)) > (1 - LEAST_COMMON) * 2 * max(len(a), len(b)):
        return False
    u, v = answer.words, prompt.words
    if min(len(u), len(v)) >= SHINGLE and 2 * len(set(u) & set(v)) >= max(len(set(u)), len(set(v))) and _contained(u, v):
        return common_subsequence(u, v) >= LEAST_COMMON * max(len(u), len(v))
    # letters that all align are as many of each kind
    if len(a) != len(b) or any(a.count(c) != b.count(c) for c in a[:2] + a[-2:]):
        return False
    return _contained(a, b) and common_subsequence(list(a), list(b)) == len(a)


def examine(df: DataFrame, table: str, key: str, prompt: str, response: str, model: Model, model_output: bool) -> DataFrame:
    """``(tbl, rec_id, canon, state, parts, defect)``: what one pass over the pairs can say; ``defect`` is null, ``empty``,
    ``refusal``, ``copied_source`` or ``other_language``. Null responses are empty; null prompts are copied by nothing;
    an ``lp`` that names no pair makes no response foreign."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = shared.value
        for batch in batches:
            if not len(batch):
                continue
            known: dict[tuple, int] = {}
            rows = []
            canon, state, defect, parts = [], [], [], []
            asked_of: list[tuple[int, str, list[str], str]] = []
            read: dict[str | None, tuple] = {}
            prompts: dict[str, Reading] = {}
            for raw, asked, target in zip(batch["raw"], batch["asked"], batch["target"], strict=True):
                case = (raw, asked, target)
                if case in known:
                    rows.append(known[case])
                    continue
                number = known[case] = len(canon)
                rows.append(number)
                if raw not in read:
                    answer = read_answer(raw, model_output)
                    ends = tail_state(answer)
                    read[raw] = (answer, ends, Reading.of(answer.text))
                answer, ends, reading = read[raw]
                words = reading.words
                if asked and asked not in prompts:
                    prompts[asked] = Reading.of(asked)
                kind = None
                if ends == EMPTY or (not answer.unclosed and not has_words(answer.text)):
                    kind = "empty"
                elif is_refusal(answer.text, words):
                    kind, ends = "refusal", COMPLETE
                elif asked and is_copy(reading, prompts[asked]):
                    kind = "copied_source"
                elif target in LABELS and words:
                    asked_of.append((number, answer.text, words, target))
                canon.append(reading.plain)
                state.append(ends)
                defect.append(kind)
                parts.append(parts_if_open(answer.text, ends) if kind is None or kind == "copied_source" else None)
            # words alone settle most; the chain labels the texts that do not look like the target's
            alone = crf.shares([w for _, _, w, _ in asked_of], [t for _, _, _, t in asked_of])
            pending = [(number, target, tokens(text)) for (number, text, _, target), share in zip(asked_of, alone, strict=True) if share < ALONE]
            for (number, target, cut), m in zip(pending, crf.marginals([c for _, _, c in pending]), strict=True):
                found = passages(cut[0], m)
                own = sum(p.words + p.han for p in found if p.language == target and (p.words >= 3 or p.han >= 5))
                sure = any(p.language != target and p.confidence >= 0.6 and (p.words >= 2 or p.han >= 4) for p in found)
                if sure and not own:
                    defect[number] = "other_language"
            crf.trim()
            yield pd.DataFrame({"rec_id": batch["rec_id"], "canon": [canon[r] for r in rows], "state": [state[r] for r in rows], "defect": [defect[r] for r in rows], "parts": [parts[r] for r in rows]})

    pairs = df.select(
        F.col(f"`{key}`").cast("bigint").alias("rec_id"), F.col(f"`{response}`").alias("raw"), F.col(f"`{prompt}`").alias("asked"), target_of_pair(F.col("lp")).alias("target")
    )
    return pairs.mapInPandas(run, f"rec_id bigint, canon string, state int, defect string, parts {PART_TYPE}").select(F.lit(table).alias("tbl"), "rec_id", "canon", "state", "parts", "defect")


def defective_pairs(benchmark: DataFrame, llm_result: DataFrame, model: Model) -> DataFrame:
    """``(tbl, rec_id, defect)``, one row for each defective pair of the two tables."""
    seen = materialize(
        examine(benchmark, "benchmark", "idx", "source", "translation", model, False).unionByName(
            examine(llm_result, "llm_result", "result_id", "source", "raw_llm_output", model, True)
        )
    )
    whole = materialize(reference_letters(benchmark.select("reference").union(benchmark.select("source"))))
    cut = judge_cut(seen.where("defect is null or defect not in ('empty', 'refusal')").select("tbl", "rec_id", "canon", "state", "parts"), whole)
    rank = F.expr("case defect when 'empty' then 1 when 'refusal' then 2 when 'truncated' then 3 when 'copied_source' then 4 else 5 end")
    kinds = seen.where("defect is not null").select("tbl", "rec_id", "defect").unionByName(cut.withColumn("defect", F.lit("truncated")))
    return kinds.withColumn("rank", rank).groupBy("tbl", "rec_id").agg(F.min_by("defect", "rank").alias("defect"))
