import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import answers, langcrf, leaks, pagespam, pairs, truncation, unicode_forms

SENTENCES = {
    "en": "The committee publishes the annual budget before the end of the month and the library keeps a map of the valley.",
    "fr": "Le comité publie le budget annuel avant la fin du mois et la bibliothèque garde une carte de la vallée.",
    "de": "Der Ausschuss veröffentlicht den Jahreshaushalt vor dem Ende des Monats und die Bücherei behält eine Karte des Tals.",
    "ru": "Комитет публикует годовой бюджет до конца месяца и библиотека хранит карту долины у моста.",
    "zh": "委员会在月底之前公布年度预算而图书馆保存一张山谷地图。",
}


@pytest.mark.parametrize("a, b, same", [("é", "é", True), ("ｔｈｅ", "the", True), ("ﬁn", "fin", True), ("a​b", "ab", True), ("x y", "x y", True), ("аrе", "are", True), ("x²", "x2", False), ("é", "e", False), ("A", "a", False), ("a.", "a", False), ("7", "8", False)])
def test_skeleton(a, b, same):
    assert (unicode_forms.skeleton(a) == unicode_forms.skeleton(b)) is same


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ae ́̈éﬁ가각가​­ｅ0a年б\n", max_size=30))
def test_stable_form_is_stable(text):
    made = unicode_forms.stable_form(text)
    assert unicode_forms.stable_form(made) == made and unicodedata.is_normalized("NFC", made)


def test_disguised_rows(spark):
    rows = [(1, "cafe\u0301", "café", "x"), (1, "cafe\u0301", "café", "x"), (2, "same", "same", None), (3, None, "a", "b"), (4, "", None, "c"), (5, "cafe", "café", "d"), (6, "х" * 3000, "x" * 3000, "e")]
    df = spark.createDataFrame(rows, "idx bigint, translation string, reference string, rec_id string")
    made = unicode_forms.disguised_rows(df, "idx", "translation", "reference", "benchmark")
    assert sorted(r.rec_id for r in made.collect()) == [1, 6]
    assert unicode_forms.disguised_rows(df.limit(0), "idx", "translation", "reference", "benchmark").count() == 0
    assert unicode_forms.normalise_columns(df, ["translation"]).where("idx = 1").first().translation == "café"


@pytest.mark.parametrize(
    "raw, text, unclosed",
    [
        (None, "", False), ("{}", "", False), ('{"extracted_translation": null}', "", False), ("```json\n```", "", False), ("<think>\nx\n</think>\n", "", False), ("<think>\nx", "x", True),
        ('```json\n{"extracted_translation": "a b.", "noise_pattern": "none"}\n```', "a b.", False), ("{'extracted_translation': 'a', 'noise_pattern': 'none',}", "a", False),
        ('{"extracted_translation": "a b', "a b", True), ("German: x", "x", False), ("{x}", "x", False), ("Here is the translation you asked for:\n\nx", "x", False), ("```\nx\n```", "x", False), ("```\nx", "x", True),
    ],
)
def test_read_answer(raw, text, unclosed):
    got = answers.read_answer(raw)
    assert (got.text, got.unclosed) == (text, unclosed)


def test_prefixes_against_brute_force(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    rows = [(v, rng.random() < 0.5) for v in values] + [("", True), (None, True)]
    wanted = {v for v, _ in rows if v and any(w and w != v and w.startswith(v) for w, _ in rows) and all(o for w, o in rows if w == v)}
    got = truncation.strict_prefixes(spark.createDataFrame(rows, "canon string, open boolean"))
    assert {r.canon for r in got.collect()} == wanted
    assert truncation.strict_prefixes(spark.createDataFrame([], "canon string, open boolean")).count() == 0


def test_cut_rows(spark):
    whole = "Der Nachtzug prüft den Fahrplan. Das Amt zeigt einen Brief im Saal."
    rows = [(1, "Das Handbuch im Saal – Nerine 12", "Das Handbuch im Saal – Nerine 12"), (2, whole[:50], whole), (3, whole[:-1], whole), (4, whole[:32], whole), (5, None, whole), (6, " ", None), (7, "...", whole), (8, whole[:45] + "…", whole), (8, whole[:45] + "…", whole), (9, "Das Handb", None)]
    bench = spark.createDataFrame([(a, "s", b, c, "x") for a, b, c in rows], "idx bigint, source string, translation string, reference string, canon string")
    outputs = spark.createDataFrame([(1, "y", "y")], "out_id bigint, translation string, reference string").limit(0)
    results = spark.createDataFrame([(1, '{"extracted_translation": "a b'), (2, "```json\n{}\n```"), (3, "<think> so"), (4, None)], "result_id bigint, raw_llm_output string")
    got = sorted((r.tbl, r.rec_id) for r in truncation.cut_rows(bench, outputs, results).collect())
    assert got == [("benchmark", 2), ("benchmark", 8), ("benchmark", 9), ("llm_result", 1), ("llm_result", 3)]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    texts = []
    for code, sentence in SENTENCES.items():
        words = list(sentence.rstrip(".。")) if code == "zh" else sentence.rstrip(".").split()
        for _ in range(30):
            k = rng.randint(0, len(words) // 3)
            texts.append((("" if code == "zh" else " ").join(words[k:] + words[:k]) + ".", code))
    return langcrf.fit(sorted(set(texts)))


def brute_marginals(model, words, breaks):
    emit = np.array([model.table[i] for i in model.ids(words)], dtype=float)
    n, labels = len(words), emit.shape[1]
    total = np.zeros((n, labels))
    for path in np.ndindex(*(labels,) * n):
        score = sum(emit[t, path[t]] for t in range(n)) + sum(model.transitions[int(breaks[t]), path[t - 1], path[t]] for t in range(1, n))
        for t in range(n):
            total[t, path[t]] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def test_forward_backward_against_all_paths(model):
    words, breaks = langcrf.tokens("the committee. Le comité")
    assert np.allclose(model.marginals([(words, breaks), (["a"], [True])])[0], brute_marginals(model, words, breaks), atol=1e-4)


@pytest.mark.parametrize("code", list(SENTENCES))
def test_language_of_one(model, code):
    words, breaks = langcrf.tokens(SENTENCES[code])
    assert {p.language for p in langcrf.passages(words, model.marginals([(words, breaks)])[0]) if p.counts} == {code}


def test_mislabelled(spark, model):
    rows = [(1, SENTENCES["en"], "German"), (2, SENTENCES["fr"], " fr-CA"), (3, SENTENCES["de"] + "\n" + SENTENCES["en"], "deu"), (4, SENTENCES["ru"], None), (5, None, "de"), (6, "", None), (7, SENTENCES["zh"] * 40, "und"), (1, SENTENCES["en"], "German")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "idx bigint, translation string, tgt_lang string, key string")
    assert sorted((r.idx, r.lang) for r in langcrf.mislabelled(df, model).collect()) == [(1, "en"), (3, "en"), (4, "ru"), (7, "zh")]
    assert langcrf.mislabelled(df.limit(0), langcrf.lexicon_model()).count() == 0


@pytest.mark.parametrize("text, wanted", [("I'm sorry, but I am not able to translate this text.", True), ("Es tut mir leid, aber diesen Text kann ich nicht übersetzen.", True), ("很抱歉，我无法翻译这段文字。", True), ("죄송하지만 이 글은 번역할 수 없습니다.", True), ("عذرا، لا أستطيع ترجمة هذا النص.", True), ("Omlouvám se, ale tento text nemohu přeložit.", True), (SENTENCES["en"], False), (SENTENCES["zh"], False), ("", False)])
def test_refusal(text, wanted):
    assert pairs.is_refusal(text, langcrf.bare_words(text)) is wanted


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert pairs.common_subsequence(a, b) == table[-1][-1]


def test_defective_pairs(spark, model):
    en, de, fr = SENTENCES["en"], SENTENCES["de"], SENTENCES["fr"]
    bench = [(1, en, de), (2, en, en.upper()), (3, en, "Translation: " + en), (4, en, fr), (5, en, None), (6, en, "​"), (7, en, "I cannot translate this text."), (8, en, de + "\n\n" + en), (9, None, de[:60]), (2, en, en.upper())]
    df = spark.createDataFrame([(a, b, "en-de", c, de, "x") for a, b, c in bench], "idx bigint, source string, lp string, translation string, reference string, defect string")
    results = spark.createDataFrame([(1, en, None, "{}"), (2, en, "en-de", f'{{"extracted_translation": "{de}"}}'), (3, en, "en-de", '{"extracted_translation": "Der Aus')], "result_id bigint, source string, lp string, raw_llm_output string")
    got = {(r.tbl, r.rec_id): r.defect for r in pairs.defective_pairs(df, results, model).collect()}
    assert got == {
        ("benchmark", 2): "copied_source", ("benchmark", 3): "copied_source", ("benchmark", 4): "other_language", ("benchmark", 5): "empty", ("benchmark", 6): "empty",
        ("benchmark", 7): "refusal", ("benchmark", 9): "truncated", ("llm_result", 1): "empty", ("llm_result", 3): "truncated",
    }


def leak_fixture():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(100 + k, " ".join(words(40))) for k in range(12)] + [(200, "".join(chr(0x4E00 + rng.randrange(40)) for _ in range(90))), (201, ""), (202, "too short")]
    docs = []
    for k in range(120):
        filler, item = words(60), rng.choice(items[:12])[1].split()
        at, n = rng.randrange(0, 20), rng.choice([8, 11, 12, 14, 15, 20])
        part = item[at : at + n]
        for _ in range(rng.choice([0, 0, 1, 2])):
            part[rng.randrange(len(part))] = "zzz"
        docs.append((k, " ".join(filler[:30]) + "\n> " + ", ".join(part).upper() + "!\n" + " ".join(filler[30:])))
    docs += [(500, "前" + items[12][1][10:34] + "后"), (501, items[12][1][10:33]), (502, None), (503, ""), (504, items[0][1] * 30), (505, f"<b>{items[1][1]}</b>")]
    return items, docs


def test_leaks_against_brute_force(spark):
    items, docs = leak_fixture()

    def holds(left, right, exact, loose):
        for d in range(-len(right), len(left)):
            same = [left[i] == right[i - d] for i in range(max(0, d), min(len(left), len(right) + d))]
            for i in range(len(same)):
                for j in range(i + exact, len(same) + 1):
                    wrong = (j - i) - sum(same[i:j])
                    if wrong == 0 or (j - i >= loose and wrong * 10 <= j - i):
                        return True
        return False

    clean = lambda t: "".join(c if c.isalnum() or c.isspace() else "" for c in t.replace("<b>", "").replace("</b>", "")).lower()
    wanted = set()
    for number, text in docs:
        for item, passage in items:
            if text and number != 504:
                left, right = clean(text), clean(passage)
                if holds(list(left), list(right), 24, 30) if item == 200 else holds(left.split(), right.split(), 12, 15):
                    wanted.add((number, item))
    wanted.add((504, 100))
    frame = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id bigint, text string, item_id string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaked(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got - {(504, i) for i in range(101, 112)} == wanted and len(wanted) > 20
    assert leaks.leaked(frame.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    assert leaks.leaked(frame, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_spam_pages(spark):
    rng = random.Random(2)
    prose = " ".join(f"The {a} near the {b} keeps a {c} for visitors." for a, b, c in (rng.sample(["museum", "harbour", "garden", "bridge", "letter", "school", "valley", "budget"], 3) for _ in range(9)))
    tags = " ".join(f"#tag{rng.randrange(99)}" for _ in range(60))
    links = "\n".join(f"https://site{rng.randrange(999)}.example/p/{rng.randrange(9999)}" for _ in range(30))
    priced = "\n".join(f"garden pump AB-{rng.randrange(999)} EUR {rng.randrange(99)}.50" for _ in range(30))
    keywords = ", ".join(rng.choice(["cheap pump", "buy pump", "pump sale"]) for _ in range(90))
    docs = [(1, prose), (2, tags), (3, links), (4, priced), (5, keywords), (6, prose + "\n\n#one #two"), (7, None), (8, " "), (9, "short"), (10, prose * 200), (11, prose[:200] + "\n" + keywords)]
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id bigint, text string, script string")
    assert sorted(r.doc_id for r in pagespam.spam_pages(df).collect()) == [2, 3, 4, 5, 11]
    assert pagespam.spam_pages(df.limit(0)).count() == 0
    assert all("".join(pagespam.blocks(t)).replace("\n", "").replace(" ", "") == t.replace("\n", "").replace(" ", "") for _, t in docs if t and t.strip())
