"""Cases that a reviewer found missing from the results."""

import unicodedata

import pytest

from palimpsest import catalogue
from palimpsest.llm import groups, leaks, queries, unicode_forms


RUSSIAN = "До особого распоряжения ремонтная мастерская исправляет сломанный насос, а вечером ночной поезд меняет маршрут у моста"


@pytest.mark.parametrize("text", [RUSSIAN, "Die große Straße am Fluß bleibt nach dem heißen Sommer bis auf weiteres für alle Gäste geschlossen"])
def test_leaks_in_capitals(text):
    index = leaks.build_index([(1, text), (2, "another text")])
    for shown in (text, text.upper(), text.title(), text.swapcase()):
        assert leaks.find(index, ["before it " + shown + " after it", "none"]) == [(0, 0)]


def test_lookalikes_are_closed_under_case():
    both = {"Ν", "ν", "Υ", "υ", "Ӏ", "ӏ"}  # each case looks like another Latin letter
    for char in unicode_forms.LOOKALIKES:
        if char not in both:
            assert unicode_forms.caseless(char) == unicode_forms.caseless(char.upper()) == unicode_forms.caseless(char.lower())
    assert unicode_forms.caseless("н") == "h" and unicode_forms.caseless("n") != unicode_forms.caseless("v")
    # what a reader sees is another matter
    assert unicode_forms.skeleton("в") != "b"


def test_same_text_in_any_case(spark):
    texts = ["Mekarome, the map of Townhall", "Мekarome, the map of Тownhall", "МЕKAROME, THE MAP OF ТOWNНALL", "mekarome,the map of townhall", "Mekarome, the map of Vownhall"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    keys = {r.k: r.h for r in df.select("k", groups.same_text_key(df.t)["key"].alias("h")).collect()}
    assert len({keys[k] for k in range(4)}) == 1 and keys[4] != keys[0]


def test_disguised_rows_of_any_length(spark):
    korean = "위원회는 월말 전에 연간 예산을 발표하고 도서관은 계곡의 지도를 보관하며 밤 기차는 다리 옆에서 노선을 바꾼다."
    rows = [(1, unicodedata.normalize("NFD", korean), korean), (2, "ﷺ " * 9, unicodedata.normalize("NFKC", "ﷺ " * 9)), (3, "…" * 40, "..." * 40), (4, unicodedata.normalize("NFD", korean), korean[:-9])]
    df = spark.createDataFrame(rows, "idx int, translation string, reference string")
    assert sorted(r.rec_id for r in unicode_forms.disguised_rows(df, "idx", "translation", "reference", "benchmark").collect()) == [1, 2, 3]


def test_canonical_texts_of_both_tables(spark, tmp_path):
    plain, other = "Café in Köln", unicodedata.normalize("NFD", "Café\u00a0in Köln")
    spark.createDataFrame([(1, other, plain), (1, other, plain), (2, None, other)], "idx bigint, reference string, translation string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, other, other, other), (2, plain, None, other)], "result_id bigint, reference string, translation string, extracted_text string").write.parquet(f"{tmp_path}/llm_result.parquet")
    got = {(r.tbl, r.rec_id): (r.reference, r.translation, r.extracted_text) for r in queries.p4_canonical(spark, str(tmp_path)).collect()}
    assert got == {
        ("benchmark", 1): (plain, plain, None), ("benchmark", 2): (None, plain, None),
        ("llm_result", 1): (plain, plain, plain), ("llm_result", 2): (plain, None, plain),
    }


def test_chinese_leaks_with_scattered_or_shifted_replacements():
    item = "".join(chr(0x4E00 + (k * 37) % 4001) for k in range(90))
    part = item[20:50]
    scattered = part[:7] + "甲" + part[8:15] + "乙" + part[16:23] + "丙" + part[24:]
    longer = part[:11] + "甲乙丙" + part[13:]
    four = part[:5] + "甲" + part[6:11] + "乙" + part[12:17] + "丙" + part[18:23] + "丁" + part[24:]
    index = leaks.build_index([(1, item)])
    assert leaks.find(index, [f"天地{t}人口" for t in (scattered, longer, four, part[:23], part[:24])]) == [(0, 0), (1, 0), (4, 0)]


def test_noise_benchmark_gives_its_rows(spark, tmp_path):
    rows = [(k, "en-de", f"The library keeps map {k}.", f"Die Bücherei behält Karte {k}.", "en", "de") for k in range(6)]
    spark.createDataFrame(rows, "idx bigint, lp string, source string, reference string, src_lang string, tgt_lang string").write.parquet(f"{tmp_path}/clean_sample.parquet")
    made = catalogue.noise_benchmark(spark, str(tmp_path)).collect()
    assert len({r.id for r in made}) == len(made) == 24
    assert {r.translation for r in made if r.label == 1} == {r[3] for r in rows} and all(r.translation for r in made if r.label == 0)
