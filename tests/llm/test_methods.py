"""Rows come through the named methods, with no limits that drop cases."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import answers, consensus, groups, langcrf, leaks, mixing, pagespam, pairs, truncation, unicode_forms

WORDS = ["harbour", "committee", "valley", "budget", "letter", "museum", "winter", "storm", "garden", "bridge", "school", "report", "of", "the", "in"]


@pytest.mark.parametrize("tail, state", [(" " + "_" * 45, truncation.COMPLETE), ("_" * 400, truncation.COMPLETE), (" And so", truncation.OPEN_PART), ("..", truncation.OPEN_PART)])
def test_ends_are_read_whole(tail, state):
    assert truncation.tail_state(answers.Answer("He went home and slept well." + tail, False, False)) == state


def test_cut_rows_by_method(spark):
    whole = "The night train checks the timetable in the hall. The office shows a letter near the bridge. The library keeps a map of the valley."
    other = "The school repairs a boat. The office shows a let"
    values = [(1, whole[:70]), (2, whole[:70]), (3, other), (4, "The school repairs a boat. The library keeps a map of the val…"), (5, "The museum repairs a boat. The office shows a letter near the bridge"), (6, "The school repairs a boat. Nothing known goes on her"), (7, "A title without a mark"), (8, "(an open bracket")]
    df = spark.createDataFrame([(*v, "x") for v in values], "idx bigint, t string, via string")
    parsed = truncation.parse(df, "benchmark", "idx", "t", False)
    refs = truncation.reference_letters(spark.createDataFrame([(whole,), (None,), ("",)], "t string"))
    got = {r.rec_id: r.via for r in truncation.verdicts(parsed, refs).collect()}
    assert got == {1: "copy", 2: "copy", 3: "part", 4: "part", 8: "structure"}


def test_refusals_of_any_length():
    long = "I'm sorry, but I can't help with translating this passage because it may contain protected content. " + "If you have another text, please send it and I will try to help you with the translation. " * 6
    korean = "죄송하지만 이 글은 번역할 수 없습니다. " * 8
    for text in (long, korean):
        assert pairs.is_refusal(text, langcrf.bare_words(text))
    for text in ("The committee decided the plan, and we decline to answer rumours.", "The library cannot provide the map of the valley.", "委员会无法提供年度预算。"):
        assert not pairs.is_refusal(text, langcrf.bare_words(text))


def test_copies_are_aligned(monkeypatch):
    asked = []
    monkeypatch.setattr(pairs, "common_subsequence", lambda a, b, real=pairs.common_subsequence: asked.append(1) or real(a, b))
    prompt = pairs.Reading.of("The museum near the harbour keeps an old map of the valley until spring.")
    copies = ["THE MUSEUM near the harbour keeps an old map of the valley until spring!", "The museum near theharbour keeps anold map of the valley until spring", "Тhe museum near the harbour keeps an old map оf the valley until spring."]
    others = ["The museum near the harbour keeps an old map of the valley until spring. And one more sentence follows.", "A garden near the bridge", ""]
    assert all(pairs.is_copy(pairs.Reading.of(t), prompt) for t in copies) and len(asked) == len(copies)
    assert not any(pairs.is_copy(pairs.Reading.of(t), prompt) for t in others)
    assert pairs.is_copy(pairs.Reading.of("titel  12"), pairs.Reading.of("Titel 12")) and not pairs.is_copy(pairs.Reading.of("Titel 13"), pairs.Reading.of("Titel 12"))


def test_leaks_are_aligned_in_a_band():
    rng = random.Random(3)
    w = [rng.choice(WORDS) for _ in range(18)]
    w[8] = "winter-storm"
    index = leaks.build_index([(1, " ".join(w)), (2, "x y")])
    found = {
        "same": w, "hyphen": [x.replace("-", " ") for x in w], "added": [*w[:9], "quite", *w[9:]], "missing": [*w[:9], *w[10:]], "replaced": [*w[:9], "zz", *w[10:]], "twelve": [*w[:12], "zzz"],
        "apart": [" ".join(x) for x in w],
    }
    lost = {"two added": [*w[:6], "quite", *w[6:12], "again", *w[12:]], "eleven": [*w[:11], "zzz"], "longer word": [*w[:11], w[11] + "xyz"]}
    for words in found.values():
        assert leaks.find(index, ["so it is " + " ".join(words) + " and more"]) == [(0, 0)]
    for words in lost.values():
        assert leaks.find(index, ["so it is " + " ".join(words) + " and more"]) == []


def test_masked_lists_are_redundant():
    rng = random.Random(4)
    lines = "\n".join(f"{rng.choice(WORDS)} AB-{rng.randrange(999)} EUR {rng.randrange(99)}.50" for _ in range(30))
    assert "AB" not in pagespam.masked(lines) and len(pagespam.masked(lines)) < len(lines)
    assert pagespam.languages(["The museum is near the bridge and it was open", "музей у моста", "xxx"]) == [("latin", "en"), ("cyrillic", "cyrillic"), ("latin", "en")]


def test_spaces_of_ascii_texts(spark):
    rows = [(1, "resume ", "resume"), (2, "résumé ", "résumé"), (3, "re sume", "resume"), (4, "resume", "resume"), (5, None, "x")]
    df = spark.createDataFrame(rows, "idx bigint, translation string, reference string")
    assert sorted(r.rec_id for r in unicode_forms.disguised_rows(df, "idx", "translation", "reference", "benchmark").collect()) == [1, 2]


def test_hubs_are_split(spark):
    edges = [(k, 1000) for k in range(60)] + [(1000 + k, 5) for k in range(1, 30)] + [(900, 901), (902, 902)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    cut = groups.split_hubs(df, most=4)
    degrees = cut.union(cut.select("b", "a")).distinct().groupBy("a").count()
    assert degrees.agg(F.max("count")).first()[0] <= 20  # a hash does not deal evenly
    got = {r.node: r.root for r in groups.components(cut).collect()}
    assert len({got[k] for k in (*range(60), *range(1000, 1030), 5)}) == 1 and got[900] == got[901] and got[900] != got[902] and got[900] != got[5]


def test_colliding_keys(spark):
    rows = spark.createDataFrame([(1, (7, 1), (8, 1)), (2, (7, 2), None), (3, (7, 1), (8, 1))], "idx bigint, s struct<key:bigint,check:bigint>, r struct<key:bigint,check:bigint>")
    got = {r.idx: (r.s, r.r) for r in groups.apart(rows, ["s", "r"]).collect()}
    assert got[1] == got[3] and got[1][0] != got[2][0] and got[1][1] == 8 and got[2][1] is None


def test_many_annotators_are_joined(spark, monkeypatch):
    from datetime import datetime

    at, rng = datetime(2026, 1, 1), random.Random(1)
    rows = [(item, f"a{k}", f"t{item}" if rng.random() < 0.5 + k / 10 else rng.choice(["", "other"]), at, at) for item in range(40) for k in range(5)]
    df = spark.createDataFrame(rows, "idx bigint, silver_model string, silver_extracted_translation string, run_at timestamp, loaded_at timestamp")
    few = {tuple(r) for r in consensus.dissenting_votes(df).collect()}
    monkeypatch.setattr(consensus, "BROADCAST_ANNOTATORS", 2)
    assert {tuple(r) for r in consensus.dissenting_votes(df).collect()} == few and few
    assert [round(x, 4) for x in consensus.beta_quantiles(3.0, 5.0, (0.025, 0.975))] == [0.099, 0.7096]


def test_exact_shares(spark):
    docs = [(k, "the old bridge near the market " * 3, "a" if k < 40 else "b") for k in range(50)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixing.mixture_report(df, targets, exact=True).collect()}
    assert report["a"].actual_share == report["b"].actual_share == 0.5 and report["b"].most_copies == 2 and report["a"].missing_share == 0
    assert mixing.mixture_report(df, targets).where("source = 'b'").first().missing_share > 0
