"""Problem 1: the language of every passage of a text, by a linear-chain conditional random field over its words.

Each word is described by its affixes, its character n-grams and its membership in small lexicons of function words; the
chain has one learned transition matrix within sentences and one across boundaries (sentence ends, line breaks, slashes),
so code-switched text is cut where languages change. Training maximises the conditional likelihood of generated
code-switched sequences made of labelled texts; labelling takes the forward-backward marginals.

The sample the model is fitted on is bounded by ``TRAINING_TEXTS`` texts a language, whatever the size of the table. It is
collected to the driver (a few hundred KB) and the fitted model, whose size that bound limits too, is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import LANGUAGES, label_language, target_of_pair
from .unicode_forms import LOOKALIKES, stable_form

#: Bound of the training sample: texts a language, chosen by hash.
TRAINING_TEXTS = 100
#: Words a passage needs; for text without spaces between words, characters.
PASSAGE_WORDS, PASSAGE_HAN = 5, 10
#: Mean marginal below which a run between others is no language of its own.
SURE = 0.75

LABELS = tuple(LANGUAGES)
_INDEX = {code: i for i, code in enumerate(LABELS)}

# Function words of the languages that share the Latin script, and a few of the others.
LEXICON = {
    "en": """the of and to in a is that it for on with as was are this be at by have from or an will not your you we my i can't
        which has had been were their they there would could should more than about into only other when who why what how some
        any all its our his her them these those do does did been being while because before after between under over
        here below following please sorry cannot can able unable but if so then no such very also just
        few people time only many small each own same way every since until during without one two three first last good carry used
        kind use make made back down off out up through where""",
    "fr": """le la les un une des du de et est en que qui dans pour pas sur au aux ce cette ces il elle nous vous ils elles avec son sa
        ses par plus ne se sont être avoir fait mais ou où donc leur leurs y on je mon ma mes votre vos notre nos c'est d'un d'une
        l'on qu'il qu'elle sans sous entre chaque après avant depuis pendant quand comme tout tous très aussi voici ici""",
    "de": """der die das und ist in den von zu mit sich des auf für nicht ein eine einen einem einer als auch es an werden aus er hat
        dass sie nach wird bei um am sind noch wie über so zum zur im vom war haben nur oder aber vor durch mein dein sein ihr
        ihre wir ich kann man wenn weil mehr hier dieser diese dieses diesen keine kein unter zwischen seit bis während""",
    "es": """el la los las de y en que un una es por con no para su se del al lo como más pero sus le ha o este esta esto sí porque
        cuando muy sin sobre también me hasta hay donde quien desde todo nos durante uno ni contra otros ese eso ante ellos e
        está son fue ser tiene puede yo mi usted aquí antes después entre cada lamento siento""",
    "it": """il lo la i gli le di e che è un una uno in per non con del della dei delle dello degli al alla ai alle da dal dalla nel nella nei
        nelle sul sulla si come più ma anche sono ha ho questo questa questi queste o se quando dove chi perché mi ti ci vi suo
        sua loro essere stato dopo prima senza sotto sopra tra fra ogni durante fino ecco posso molto dell' l' un'""",
    "pt": """o a os as de e que do da dos das em um uma é para com não por no na nos nas ao à aos se mais como mas foi ele ela seu sua
        ou ser quando muito há já está eu também só pelo pela até isso entre era depois sem mesmo seus quem porque nem são
        este esta esse essa num numa você meu minha antes sob cada durante desde após peço desculpa""",
    "pl": """i w na z do się nie to jest że o jak za od po przez przy dla ale co czy tak są był była było być może już tylko jego jej
        ich ten ta te tego tej tym oraz lub gdy kiedy który która które których gdzie bez pod nad przed między każdy ja my wy
        mogę więc także bardzo a u ze we podczas według mimo niż dwa razy roku""",
    "cs": """a v na se je že s z do o k i to jako za by ale si po pro od jsou jsem byl byla bylo být nebo tak už jen jeho její
        jejich který která které kteří když kde bez pod nad před mezi každý kdo proč co může podle také více ve ze u při
        tento tato toto tohoto nemohu omlouvám během přes až jak není""",
    "ru": """и в не на я что с он а как это по но они к у из за от мы для вы так же о при до без под над перед после когда где кто
        почему или ещё только может быть был была было которые который""",
    "zh": "的 了 是 在 我 有 和 不 这 人 们 你 他 她 它 吗 很 也 都 就 要 会 能 请 为 以 对 中 上 下 后 前",
    "ko": "은 는 이 가 을 를 의 에 에서 로 으로 와 과 도 만 하다 있다 없다 이다 그리고 그러나 합니다 입니다 습니다 수 없습니다",
    "ar": "في من على إلى عن مع أن إن هذا هذه التي الذي كان لا ما هو هي و أو ثم لم لن قد كل بعد قبل عند بين عذرا لا أستطيع هل",
}
# Scripts by range.
_SCRIPTS = (
    ("han", 0x3400, 0x9FFF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("arabic", 0x600, 0x6FF), ("arabic", 0xFB50, 0xFEFF),
    ("cyrillic", 0x400, 0x52F), ("greek", 0x370, 0x3FF), ("han", 0xF900, 0xFAFF),
)
_TOKEN = re.compile(r"[㐀-鿿\uf900-\ufaff]+|[^\W\d_㐀-鿿\uf900-\ufaff]+(?:['’][^\W\d_㐀-鿿\uf900-\ufaff]+)*")
_SPLIT = re.compile(f"({_TOKEN.pattern})")
_HAN = re.compile(r"[㐀-鿿\uf900-\ufaff]")
_BREAK = re.compile(r"[.!?:;。！？：；؟\n/|→•]|\s[-–—]\s")
_TO_LATIN = {ord(k): v for k, v in LOOKALIKES.items() if v.isascii()}
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_LEX: dict[str, list[str]] = {}
for _code, _words in LEXICON.items():
    for _word in _words.split():
        _LEX.setdefault(_word, []).append(_code)
FUNCTION_WORDS = frozenset(_LEX)


def lexicon_codes(word: str) -> list[str]:
    """Languages that have the word in their lexicon."""
    return _LEX.get(word, [])


def has_han(text: str) -> bool:
    return _HAN.search(text) is not None


def script_of(word: str) -> str:
    code = ord(word[0])
    for name, first, last in _SCRIPTS:
        if first <= code <= last:
            return name
    return "latin" if code < 0x250 or 0x1E00 <= code <= 0x1EFF else "other"


@lru_cache(maxsize=8192)
def _parts(gap: str) -> bool:
    """Is there a boundary in what lies between two words?"""
    return len(gap) > 1 and _BREAK.search(gap) is not None


def tokens(text: str) -> tuple[list[str], list[bool]]:
    """Words in folded case, and whether a boundary lies before each."""
    pieces = _SPLIT.split((text if text.isascii() else stable_form(text) or "").lower())
    words = pieces[1::2]
    breaks = [gap != " " and _parts(gap) for gap in pieces[:-1:2]]
    if breaks:
        breaks[0] = True
    return words, breaks


def bare_words(text: str) -> list[str]:
    """The words of :func:`tokens`, without their boundaries."""
    return _TOKEN.findall((text if text.isascii() else stable_form(text) or "").lower())


def features(word: str) -> list[str]:
    """What is said of a word: script, lexicons, affixes and character n-grams."""
    if script_of(word) in ("cyrillic", "greek") and _LATIN.search(word):
        word = word.translate(_TO_LATIN)
    elif _LATIN.search(word) and not word.isascii():
        word = word.translate(_TO_LATIN)
    script = script_of(word)
    out = [f"c:{script}"]
    out += [f"l:{code}" for code in _LEX.get(word, ())]
    if script == "han":
        return out
    out.append(f"w:{word}")
    if "'" in word or "’" in word:
        head, _, tail = word.replace("’", "'").partition("'")
        out += [f"e:{head}'", f"w:{tail}", *(f"l:{code}" for code in _LEX.get(tail, ()))]
        word = tail or head
    edged = f"<{word}>"
    for n in (1, 2, 3, 4):
        out.append(f"p{n}:{word[:n]}")
        out.append(f"s{n}:{word[-n:]}")
    for n in (2, 3, 4):
        out += [f"g:{edged[i : i + n]}" for i in range(len(edged) - n + 1)]
    out += [f"d:{c}" for c in set(word) if ord(c) > 127]
    return out


@dataclass
class Model:
    """Weights of the features, and the two transition matrices (within a sentence, across a boundary), in log space."""

    index: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    known: dict[str, int] = field(default_factory=dict, repr=False)
    table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"index": self.index, "weights": self.weights, "transitions": self.transitions, "known": {}, "table": None}

    def ids(self, words: list[str]) -> list[int]:
        """Row of ``table`` for each word; the table grows by the words it has not."""
        get = self.known.get
        rows = [get(w, -1) for w in words]
        if -1 in rows:
            for k, w in enumerate(words):
                if rows[k] < 0:
                    rows[k] = self._learn(w)
        return rows

    def _learn(self, word: str) -> int:
        row = self.known.get(word)
        if row is None:
            row = self.known[word] = len(self.known)
            if self.table is None or row >= len(self.table):
                grown = np.zeros((max(4096, 2 * row), len(LABELS)), dtype=np.float32)
                if self.table is not None:
                    grown[: len(self.table)] = self.table
                self.table = grown
            ids = [i for f in features(word) if (i := self.index.get(f)) is not None]
            self.table[row] = self.weights[ids].sum(axis=0) if ids else 0
        return row

    def trim(self, most: int = 300_000) -> None:
        """Memory of a worker, not of the result: between batches a table grown too large is started anew."""
        if len(self.known) > most:
            self.known, self.table = {}, None

    def shares(self, texts: list[list[str]], labels: list[str]) -> np.ndarray:
        """For each list of words, none empty, the mean probability of its label over the words, each looked at alone."""
        if not texts:
            return np.zeros(0)
        ids = [self.ids(words) for words in texts]
        sizes = np.array([len(x) for x in ids])
        rows = self.table[: len(self.known)]
        p = np.exp(rows - rows.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        flat = p[np.concatenate(ids), np.repeat([_INDEX[label] for label in labels], sizes)]
        return np.add.reduceat(flat, np.r_[0, np.cumsum(sizes)[:-1]]) / sizes

    def marginals(self, sequences: list[tuple[list[str], list[bool]]]) -> list[np.ndarray]:
        """Forward-backward marginals (words x labels) of each sequence, batched over sequences of like length."""
        out: list[np.ndarray] = [np.zeros((0, len(LABELS)), dtype=np.float32)] * len(sequences)
        order = sorted((i for i in range(len(sequences)) if sequences[i][0]), key=lambda i: len(sequences[i][0]))
        at = 0
        while at < len(order):
            longest, end = len(sequences[order[at]][0]), at
            while end < len(order) and end - at < 512 and len(sequences[order[end]][0]) <= max(longest + 8, longest * 5 // 4) and (end - at + 1) * len(sequences[order[end]][0]) <= 200_000:
                end += 1
            end = max(end, at + 1)
            group = order[at:end]
            for i, m in zip(group, self._batch([sequences[i] for i in group]), strict=True):
                out[i] = m
            at = end
        return out

    def _batch(self, batch: list[tuple[list[str], list[bool]]]) -> Iterable[np.ndarray]:
        rows, width, n = len(batch), max(len(w) for w, _ in batch), len(LABELS)
        emit = np.zeros((width, rows, n), dtype=np.float32)
        cross = np.zeros((width, rows), dtype=bool)
        for r, (words, breaks) in enumerate(batch):
            rows_of = self.ids(words)
            emit[: len(words), r] = self.table[rows_of]
            cross[: len(words), r] = breaks
        lengths = np.array([len(w) for w, _ in batch])
        emit = np.exp(emit - emit.max(axis=2, keepdims=True))
        within, across = np.exp(self.transitions - self.transitions.max(axis=(1, 2), keepdims=True)).astype(np.float32)
        ahead = np.empty_like(emit)
        state = emit[0] / emit[0].sum(axis=1, keepdims=True)
        ahead[0] = state
        for t in range(1, width):
            state = np.where(cross[t][:, None], state @ across, state @ within) * emit[t]
            state /= state.sum(axis=1, keepdims=True)
            ahead[t] = state
        back = np.full((rows, n), 1.0 / n, dtype=np.float32)
        for t in range(width - 1, -1, -1):
            ahead[t] *= back
            ahead[t] /= ahead[t].sum(axis=1, keepdims=True)
            if t:
                # beyond its end a sequence carries the neutral message
                inside = (t < lengths)[:, None]
                message = emit[t] * back
                message = np.where(cross[t][:, None], message @ across.T, message @ within.T)
                back = np.where(inside, message / message.sum(axis=1, keepdims=True), 1.0 / n).astype(np.float32)
        return (ahead[: lengths[r], r] for r in range(rows))


@dataclass(frozen=True)
class Passage:
    language: str
    words: int
    han: int
    confidence: float

    @property
    def counts(self) -> bool:
        return self.han >= PASSAGE_HAN if self.language == "zh" else self.words >= PASSAGE_WORDS


def passages(words: list[str], marginal: np.ndarray) -> list[Passage]:
    """Runs of equal most probable language. A run the model is unsure of (mean marginal under ``SURE``) takes the language
    of the neighbour that is the more probable of the two for its words."""
    if not words:
        return []
    n = len(words)
    best = marginal.argmax(axis=1)
    bounds = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), n]
    if len(bounds) > 2:
        top = np.add.reduceat(marginal.max(axis=1), bounds[:-1]).tolist()
        unsure = [k for k, total in enumerate(top) if total < SURE * (bounds[k + 1] - bounds[k])]
        for k in unsure:
            first, last = bounds[k], bounds[k + 1]
            near = [int(best[j]) for j in (first - 1, last) if 0 <= j < n]
            best[first:last] = max(near, key=lambda label: float(marginal[first:last, label].sum()))
        if unsure:
            bounds = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), n]
    out = []
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        label = int(best[first])
        han = sum(len(w) for w in words[first:last] if w[0] >= "\u3400" and _HAN.match(w))
        out.append(Passage(LABELS[label], last - first, han, float(marginal[first:last, label].sum()) / (last - first)))
    return out


def _sequences(texts: list[tuple[str, str]], rng: np.random.Generator) -> list[tuple[list[str], list[bool], list[int]]]:
    """Code-switched training sequences: pieces of labelled texts of one or more languages, with and without boundary."""
    pieces = []
    for text, code in texts:
        words, breaks = tokens(text)
        at = 0
        while at < len(words):
            size = int(rng.integers(4, 32))
            pieces.append((words[at : at + size], breaks[at : at + size], _INDEX[code]))
            at += size
    order = rng.permutation(len(pieces))
    out, at = [], 0
    while at < len(order):
        words, breaks, labels = [], [], []
        for k in order[at : at + int(rng.integers(1, 4))]:
            w, b, label = pieces[k]
            at += 1
            words += w
            breaks += [bool(rng.random() < 0.9), *b[1:]]
            labels += [label] * len(w)
        out.append((words, breaks, labels))
    return out


def fit(texts: list[tuple[str, str]], epochs: int = 4, seed: int = 7) -> Model:
    """Maximum conditional likelihood by Adam on batches of sequences; whole-word and long n-gram features are dropped at
    random so that affixes and lexicons carry words the sample has not. Texts must be sorted: the result is then the same
    whatever the order of the table."""
    rng = np.random.default_rng(seed)
    n = len(LABELS)
    data = _sequences(texts, rng)
    vocabulary = sorted({w for words, _, _ in data for w in words})
    index: dict[str, int] = {}
    described = [np.array([index.setdefault(f, len(index)) for f in features(w)]) for w in vocabulary]
    names = list(index)
    for code in LABELS:
        index.setdefault(f"l:{code}", len(index))
    droppable = np.array([f[:2] in ("w:", "e:") or (f[:2] == "g:" and len(f) > 5) for f in names] + [False] * (len(index) - len(names)))
    weights = np.zeros((len(index), n), dtype=np.float32)
    for code, i in _INDEX.items():  # prior of the lexicons: a listed word speaks for its language
        weights[index[f"l:{code}"], i] = 1.0
    transitions = np.zeros((2, n, n), dtype=np.float32)
    transitions[0] += 3 * np.eye(n, dtype=np.float32)
    transitions[1] += np.eye(n, dtype=np.float32)
    number = {w: i for i, w in enumerate(vocabulary)}
    moments = [np.zeros_like(x) for x in (weights, weights, transitions, transitions)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for start in range(0, len(order), 64):
            batch = [data[i] for i in order[start : start + 64]]
            width, rows = max(len(w) for w, _, _ in batch), len(batch)
            types, mask, cross, gold = np.zeros((width, rows), dtype=int), np.zeros((width, rows), dtype=bool), np.zeros((width, rows), dtype=bool), np.zeros((width, rows), dtype=int)
            for r, (words, breaks, labels) in enumerate(batch):
                k = len(words)
                types[:k, r], mask[:k, r], cross[:k, r], gold[:k, r] = [number[w] for w in words], True, breaks, labels
            used, inverse = np.unique(types, return_inverse=True)
            inverse = inverse.reshape(types.shape)
            chosen = [described[u] for u in used]
            chosen = [c[~droppable[c] | (rng.random(len(c)) < 0.5)] for c in chosen]
            sizes = np.array([len(c) for c in chosen])
            flat = np.concatenate(chosen)
            of_type = np.add.reduceat(weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
            emit = of_type[inverse]
            shift = emit.max(axis=2, keepdims=True)
            emit = np.where(mask[:, :, None], np.exp(emit - shift), 1.0)
            moves = np.exp(transitions)
            ahead, scale = np.empty_like(emit), np.ones((width, rows, 1))
            state = emit[0] / emit[0].sum(axis=1, keepdims=True)
            ahead[0] = state
            for t in range(1, width):
                nxt = np.where(cross[t][:, None], state @ moves[1], state @ moves[0]) * emit[t]
                scale[t] = nxt.sum(axis=1, keepdims=True)
                state = np.where(mask[t][:, None], nxt / scale[t], state)
                ahead[t] = state
            back = np.ones((rows, n))
            grad_type = np.zeros_like(of_type)
            grad_moves = np.zeros_like(transitions, dtype=float)
            for t in range(width - 1, -1, -1):
                m = mask[t]
                marginal = ahead[t] * back
                marginal /= marginal.sum(axis=1, keepdims=True)
                marginal[np.arange(rows), gold[t]] -= 1.0
                np.add.at(grad_type, inverse[t][m], marginal[m])
                if t:
                    message = emit[t] * back
                    for kind in (0, 1):
                        at = m & (cross[t] == bool(kind))
                        if at.any():
                            pair = ahead[t - 1][at][:, :, None] * moves[kind][None] * message[at][:, None, :]
                            pair /= pair.sum(axis=(1, 2), keepdims=True)
                            grad_moves[kind] += pair.sum(axis=0)
                            np.add.at(grad_moves[kind], (gold[t - 1][at], gold[t][at]), -1.0)
                    message = np.where(cross[t][:, None], message @ moves[1].T, message @ moves[0].T)
                    back = np.where(m[:, None], message / message.sum(axis=1, keepdims=True), back)
            step += 1
            count = mask.sum()
            grad = np.zeros_like(weights)
            np.add.at(grad, flat, np.repeat(grad_type, sizes, axis=0).astype(np.float32))
            for value, g, m1, m2, rate, decay in ((weights, grad / count * 50, moments[0], moments[1], 0.08, 1e-4), (transitions, grad_moves / count * 50, moments[2], moments[3], 0.08, 1e-4)):
                g = (g + decay * value).astype(np.float32)
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                value -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
    keep = np.abs(weights).max(axis=1) > 0.02
    kept = {f: i for f, i in index.items() if keep[i]}
    renumber = {f: k for k, f in enumerate(kept)}
    return Model(renumber, np.ascontiguousarray(weights[list(kept.values())]), transitions)


def training_texts(pairs: DataFrame, limit: int = TRAINING_TEXTS) -> list[tuple[str, str]]:
    """At most ``limit`` texts a language out of ``(lp, source, reference)``, chosen by hash of the text and sorted."""
    first = F.regexp_extract(F.lower(F.coalesce(F.col("lp"), F.lit(""))), r"^\s*(\p{L}+)", 1)
    labelled = pairs.select(F.explode(F.array(F.struct(F.col("source").alias("text"), label_language(first).alias("code")), F.struct(F.col("reference").alias("text"), target_of_pair(F.col("lp")).alias("code")))).alias("x")).select("x.*")
    labelled = labelled.where(F.col("text").isNotNull() & F.col("code").isin(*LABELS) & (F.length("text") > 20)).withColumn("h", F.xxhash64("text", "code"))
    # the rank is taken within each input partition before the shuffle (window group limit), so few rows move
    ranked = labelled.distinct().withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("h", "text"))).where(F.col("r") <= limit)
    return sorted((row.text, row.code) for row in ranked.select("text", "code").collect())


def fit_from(pairs: DataFrame) -> Model:
    """A model fitted on the bounded sample; with no usable text, a model of scripts and lexicons alone."""
    texts = training_texts(pairs)
    if not texts:
        return lexicon_model()
    return fit(texts)


@lru_cache(maxsize=1)
def lexicon_model() -> Model:
    """Scripts and lexicons with fixed weights: what is used when there is nothing to learn from."""
    index = {f"l:{code}": i for i, code in enumerate(LABELS)}
    weights = np.eye(len(LABELS), dtype=np.float32) * 2
    for script, code in (("han", "zh"), ("hangul", "ko"), ("arabic", "ar"), ("cyrillic", "ru")):
        index[f"c:{script}"] = len(index)
        weights = np.vstack([weights, np.eye(len(LABELS), dtype=np.float32)[[_INDEX[code]]] * 6])
    transitions = np.stack([3 * np.eye(len(LABELS)), np.eye(len(LABELS))]).astype(np.float32)
    return Model(index, weights, transitions)


PASSAGE_TYPE = "array<struct<language:string,words:int,han:int,confidence:double>>"


def label_passages(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """``(rec_id, passages)``: the language passages of each row's text, in order. Null, blank and wordless texts have an
    empty array. Rows are labelled whole, however long."""
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = shared.value
        for batch in batches:
            if not len(batch):
                continue
            distinct = {t: None for t in batch["text"] if t is not None}
            cut = [tokens(t) for t in distinct]
            found = {}
            for t, (words, _), m in zip(distinct, cut, crf.marginals(cut), strict=True):
                found[t] = [{"language": p.language, "words": p.words, "han": p.han, "confidence": p.confidence} for p in passages(words, m)]
            crf.trim()
            yield pd.DataFrame({"rec_id": batch["rec_id"], "passages": [found[t] if t is not None else [] for t in batch["text"]]})

    return df.select(F.col(f"`{key}`").cast("bigint").alias("rec_id"), F.col(f"`{text}`").alias("text")).mapInPandas(run, f"rec_id bigint, passages {PASSAGE_TYPE}")


def mislabelled(benchmark: DataFrame, model: Model) -> DataFrame:
    """``(idx, lang)`` of every language a translation has a passage in and ``tgt_lang`` does not name. One row for repeated
    rows; null and blank translations give none; a label that names no language is answered with every language.

    Rows are labelled where they are read; only the found languages are shuffled."""
    shared = benchmark.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = shared.value
        for batch in batches:
            distinct = list(dict.fromkeys(batch["translation"]))
            cut = [tokens(t) for t in distinct]
            found = {t: sorted({p.language for p in passages(words, m) if p.counts}) for t, (words, _), m in zip(distinct, cut, crf.marginals(cut), strict=True)}
            crf.trim()
            rows = [(idx, lang) for idx, t, named in zip(batch["idx"], batch["translation"], batch["named"], strict=True) for lang in found[t] if lang != named]
            if rows:
                yield pd.DataFrame(rows, columns=["idx", "lang"])

    rows = benchmark.where("translation is not null and idx is not null").select(F.col("idx").cast("bigint").alias("idx"), "translation", label_language(F.col("tgt_lang")).alias("named"))
    return rows.mapInPandas(run, "idx bigint, lang string").distinct()
