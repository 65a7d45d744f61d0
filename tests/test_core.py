import json

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import cleanup, explanations, parsing, prompts, scripts, text
from palimpsest.functions.models import EchoProvider, LengthScorer, complete, detect_language, provider_factory, standard_code
from palimpsest.operators import align, metrics, noise, rulebase, spans, splits, votes
from palimpsest.plans import baseline, benchmark_build, evaluation, methods, silver
from palimpsest.sources import readers, writers

C = F.col


def one(spark, expression, **values):
    names = list(values) or ["x"]
    row = tuple(values.values()) or (None,)
    df = spark.createDataFrame([row], ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, row)))
    return df.select(expression.alias("r")).first()["r"]


@pytest.mark.parametrize("given, wanted", [(None, ""), (" é", "é"), ("\x1ca　", "a"), (" \x85b\x1f", "b"), ("", "")])
def test_normalize(spark, given, wanted):
    assert one(spark, text.normalize_text(C("t")), t=given) == wanted


@pytest.mark.parametrize("a, b, wanted", [(None, "", 1.0), ("ab", "abcd", 0.5), ("x" * 8, "y" * 10, 0.8), (None, "ab", 0.0)])
def test_coverage(spark, a, b, wanted):
    assert one(spark, text.coverage(C("a"), C("b")), a=a, b=b) == wanted
    assert one(spark, text.curated_label(C("a"), C("b")), a=a, b=b) == int(wanted > 0.8)


def test_category(spark):
    assert [one(spark, text.noise_category(C("p")), p=p) for p in ("none", "code_block", "off_topic", "a+b", "", None)] == ["clean", "formatting", "content", None, None, None]


@pytest.mark.parametrize(
    "function, given, wanted",
    [
        (cleanup.strip_code_block, "```\nx\n```", "x"), (cleanup.strip_code_block, "```x```", "```x```"), (cleanup.strip_code_block, "```\nx\nfoo```", "x\nfoo```"),
        (cleanup.strip_special_formatting, "[[x]]", "x"), (cleanup.strip_special_formatting, "{{x}}", "x"), (cleanup.strip_special_formatting, "{x}", "{x}"), (cleanup.strip_special_formatting, "[[]]", ""),
        (cleanup.strip_language_prefix, "FRENCH : x", "x"), (cleanup.strip_language_prefix, "note: x", "note: x"),
        (cleanup.strip_extra_punctuation, "a!!!", "a!"), (cleanup.strip_extra_punctuation, "a!!", "a!!"), (cleanup.strip_extra_punctuation, "a??!!!", "a??!"), (cleanup.strip_extra_punctuation, "a???\n", "a?"),
        (cleanup.clean_formatting, "```\n[[German: a!!!]]\n```", "a!"), (cleanup.clean_formatting, None, None), (cleanup.clean_formatting, "", ""),
    ],
)
def test_cleanup(spark, function, given, wanted):
    assert one(spark, function(C("t")), t=given) == wanted


@pytest.mark.parametrize(
    "given, reference, wanted",
    [
        ("10:30", None, True), ("a b c: x", None, True), ("a b c d: x", None, False), ("  ", None, True), (None, None, True), ("x" * 101, "r" * 50, False), ("x" * 103, "r" * 51, True),
        ("a\n\nb", None, False), ("a\n\nb\n\nc", None, True), ("\n".join("abcdef"), None, False), ("\n".join("abcdefg"), None, True), ("# head", None, True), ("see <b>x</b>", None, True), ("y\n1. z", None, True),
    ],
)
def test_explanation(spark, given, reference, wanted):
    assert one(spark, explanations.contains_explanation(C("t"), C("r")), t=given, r=reference) is wanted


@pytest.mark.parametrize("given, code, wanted", [("Привет мир", "ru", True), ("Hello world", "ru", False), ("何か", "es", True), ("…" * 3, "fr", True), ("…" * 10, "fr", False), (None, "fr", False), ("x", None, False), ("x", "", False)])
def test_language(spark, given, code, wanted):
    assert one(spark, scripts.is_correct_language(C("t"), C("c")), t=given, c=code) is wanted


def test_language_with_model(spark):
    df = spark.createDataFrame([("bonjour tout le monde ici", "fr", "fr", 0.9), ("bonjour", "fr", "en", 0.6), ("bonjour", "fr", "en", 0.1)], "t string, c string, d string, p double")
    assert [r.r for r in df.select(scripts.is_correct_language(C("t"), C("c"), C("d"), C("p")).alias("r")).collect()] == [True, True, True]
    assert [one(spark, scripts.character_script(C("t")), t=t) for t in ("a", "я", "中", "…", "か")] == ["LATIN", "CYRILLIC", "HAN", "COMMON", "UNKNOWN"]

    class Fixed:
        def detect(self, texts):
            return [("fr", 0.8)] * len(texts)

    got = detect_language(df.select("t").unionByName(spark.createDataFrame([(None,)], "t string")), "t", Fixed).select("detected_lang", "confidence").collect()
    assert [tuple(r) for r in got] == [("fr", 0.8)] * 3 + [(None, 0.0)]


def test_parsers():
    assert parsing.read_result('```json\n{"extracted_translation": ["a", "b"]}\n```') == ("a", None)
    assert parsing.read_result('{"extracted_translation": "a" "noise_pattern": "none"}') == ("a", "none")
    assert parsing.read_result('{"extracted_translation": „a“, "noise_pattern": "x"}') == ("a", "x")
    assert parsing.read_result("123") == ("123", None) and parsing.read_result(None) == (None, None)
    assert parsing.read_silver("plain") == (None, None)
    assert parsing.read_silver('<think>{}</think> {"extracted_translation": ["v"]}')[0] == "v"
    assert parsing.read_silver('so {"extracted_translation": "e"} yes')[0] == "e"
    assert parsing.read_extractor('x</think> {"extracted_translation":"x","noise_pattern":"none"}') == ("x", "none")
    assert parsing.read_extractor('{"extracted_translation": null}') == ('{"extracted_translation": null}', None)
    assert parsing.read_extractor("Thinking Process: a\n\nb\n\n") == ("b", None)


@pytest.mark.parametrize(
    "ballots, majority, trusted",
    [
        (("a", "a", " a "), ("a", 3), ("a", 3)), ((" a", "b", "a"), (" a", 2), (" a", 2)), (("a", "b", ""), ("a", 1), (None, 1)), ((None, None, "b"), ("b", 1), ("b", 1)),
        ((None, "", " "), (None, 0), (None, 1)), (("a", "b", "b"), ("b", 2), ("b", 2)),
    ],
)
def test_votes(spark, ballots, majority, trusted):
    df = spark.createDataFrame([ballots], "a string, b string, c string")
    v = [C("a"), C("b"), C("c")]
    row = df.select(votes.majority_vote(v).alias("m"), votes.aggregate_votes(v).alias("t")).first()
    assert tuple(row.m) == majority and tuple(row.t) == trusted


def test_vote_tables(spark):
    empty = spark.createDataFrame([], "idx int, agreement int")
    assert {r.agreement: (r.n, r.share) for r in votes.agreement_distribution(empty, "agreement").collect()} == dict.fromkeys((3, 2, 1, 0), (0, 0.0))
    df = spark.createDataFrame([(1, None, 0), (2, "x", 1), (3, "y", 2)], "idx int, chosen string, agreement int")
    none, ties = votes.inspection_rows(df, "chosen", "agreement")
    assert [r.idx for r in none.collect()] == [1] and [r.idx for r in ties.collect()] == [2]


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, "x"), (0, 1, "clean"), (1, 0, None), (0, 0, "clean"), (None, 0, "clean")], "gold int, pred int, cat string")
    row = metrics.binary_metrics(df, "gold", "pred").first()
    assert (row.tp, row.fp, row.fn, row.tn, row.precision, row.recall, row.f1, row.accuracy) == (1, 1, 1, 2, 0.5, 0.5, 0.5, 0.6)
    none = metrics.binary_metrics(df.where("gold = 0 and pred = 0"), "gold", "pred").first()
    assert (none.precision, none.recall, none.f1, none.accuracy) == (0.0, 0.0, 0.0, 1.0)
    by = {r.category: r.tp + r.fp + r.fn + r.tn for r in metrics.category_breakdown(df, "gold", "pred", "cat").collect()}
    assert by == {"x": 1, "clean": 3, "unknown": 1, "noisy_only": 2}
    assert metrics.binary_metrics(df.limit(0), "gold", "pred").first().accuracy == 0.0


@pytest.mark.parametrize("extracted, truth, wanted", [(None, "", True), ("a", "", False), (" a ", "a", True), (None, "a", False)])
def test_extraction(spark, extracted, truth, wanted):
    assert one(spark, metrics.extraction_match(C("e"), C("t")), e=extracted, t=truth) is wanted


def test_confusion_and_prediction(spark):
    df = spark.createDataFrame([(1, "code_block", "code_block", "formatting"), (1, "off_topic", "explanation", "content"), (None, None, "explanation", "combo"), (0, "none", "none", "clean")], "n int, p string, g string, c string")
    row = metrics.noise_prediction(df, "n", "p", "g", "c").first()
    assert (row.total_noisy, row.pattern_correct, row.category_correct) == (3, 1, 2)
    grid = {(r.gold, r.pred): r.n for r in metrics.category_confusion(df, "n", "p", "c").collect()}
    assert grid == {("formatting", "formatting"): 1, ("content", "content"): 1, ("formatting", "content"): 0, ("content", "formatting"): 0}


def test_spans(spark):
    df = spark.createDataFrame([(1, "a\nb\n\nc"), (2, "\n".join(map(str, range(21)))), (3, None), (4, " x ")], "idx int, t string")
    got = {r.idx: [s.text for s in r.s] for r in df.select("idx", spans.spans_of(C("t")).alias("s")).collect()}
    assert got[1] == ["a", "a\nb", "a\nb\nc", "b", "b\nc", "c"] and len(got[2]) == 210 and got[3] == [] and got[4] == ["x"]
    rows = spans.explode_spans(df, "t", ["idx"]).withColumn("score", F.lit(1.0))
    assert {r.idx: r.best_span for r in spans.best_span(rows, ["idx"], "score").collect()} == {1: "a", 2: "0", 4: "x"}


def test_noise(spark):
    args = [F.lit(x) for x in ("xx", "zh", "s", "k")]
    made = lambda f, t: one(spark, f(C("t"), *args), t=t)
    assert made(noise.language_prefix, "x") == "Chinese: x" and made(noise.code_block, "x") == "```\nx\n```"
    assert one(spark, noise.language_prefix(C("t"), args[0], F.lit("xx"), args[2], args[3]), t="x") == "XX: x"
    assert made(noise.special_formatting, "x") in ("[[x]]", "{x}")
    assert made(noise.extra_punctuation, "a!") in ("a!!", "a!!!", "a!!!!") and made(noise.extra_punctuation, "a?") in ("a??", "a???") and made(noise.extra_punctuation, "a.") in ("a.!!", "a.??")
    assert one(spark, noise.draw(C("t"), 1 << 32), t="a") == 214005177


def test_splits(spark):
    df = spark.createDataFrame([(i, "en-zh" if i < 5 else "a-b", f"s{i}") for i in range(9)], "idx int, lp string, source string")
    got = {(r.lp, r.split): r["count"] for r in splits.stratified_split(df, "lp", "idx").groupBy("lp", "split").count().collect()}
    assert got == {("en-zh", "dev"): 2, ("en-zh", "test"): 3, ("a-b", "dev"): 2, ("a-b", "test"): 2}
    ids = [one(spark, splits.entry_id(F.lit("en-zh"), C("n"), F.lit("clean")), n=n) for n in (7, 1234)]
    assert ids == ["en-zh_007_clean", "en-zh_1234_clean"]
    assert splits.sample_per_group(df, "lp", "idx", 2).count() == 4


def test_align(spark):
    a = spark.createDataFrame([(1, "x", 0), (2, "y", 1)], "idx int, t string, label int")
    b = spark.createDataFrame([(2, 5), (1, 6)], "idx int, label int")
    assert {r.idx: r.label for r in align.merge_results(a, b).collect()} == {1: 6, 2: 5}
    with pytest.raises(align.LengthMismatch):
        align.check_lengths(a, b.limit(1))
    twice = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (1, 2, "new")], "k int, at int, v string")
    assert [r.v for r in align.latest(twice, ["k"], ["at"]).collect()] == ["new"]


def test_prompts(spark):
    made = prompts.silver_prompt(*[C(c) for c in "tsrab"], F.lit(None).cast("array<string>"))
    got = one(spark, made, t="x" * 10_001, s=None, r="r", a=None, b="de")
    assert "Noise: unknown" in got and got.endswith("x\n[... truncated ...]") and "? to de" in got
    messages = one(spark, prompts.noise_messages(C("p"), F.lit("s"), F.lit("c"), F.lit("en"), F.lit("de")), p="off_topic")
    assert len(messages) == 4 and messages[0]["content"] == prompts.NOISE_SYSTEMS["off_topic"]


def test_models(spark):
    df = spark.createDataFrame([(1, [("user", "Output: hallo")])], "idx int, messages array<struct<role:string,content:string>>")
    assert json.loads(complete(df, "messages", EchoProvider).first().raw_response)["extracted_translation"] == "hallo"

    class Broken:
        def create(self, messages, max_tokens, **options):
            raise OSError

    assert complete(df, "messages", Broken, wait=0).first().raw_response is None
    assert LengthScorer().score(["ab"], ["abcd"]) == [0.5]


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\nbroken\n')
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int", tolerant=True).count() == 2
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").collect()
    (tmp_path / "a.tsv").write_text('source\treference\tz\nx\\ny\tq\t1\n')
    assert readers.read_input(spark, str(tmp_path / "a.tsv")).first().source == "x\ny"
    (tmp_path / "m" / "en-de").mkdir(parents=True)
    (tmp_path / "m" / "en-de" / "test_translations.jsonl").write_text("{}")
    assert readers.discover_models(spark, str(tmp_path)) == ["m"] and readers.discover_models(spark, str(tmp_path), ["z", "m"]) == ["m"]
    assert readers.find_translation_file(spark, str(tmp_path), "en-de", "test", "m").endswith("en-de/test_translations.jsonl")
    assert readers.candidate_files("p", "test", "X-Thinking") == ["p/test_translations.jsonl"] and len(readers.candidate_files("p", "test", "x")) == 2
    assert readers.target_language_of_path("a/Russian-French/x") == "fr" and readers.target_language_of_path("a/b") == ""
    assert one(spark, readers.method_name(C("p")), p="o/results/a/b/c.jsonl") == "a/b" and one(spark, readers.method_name(C("p")), p="x/y.jsonl") == "y"
    df = spark.createDataFrame([(1, None)], "a int, b string")
    writers.write_jsonl(df, str(tmp_path / "out"))
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    assert writers.write_inspection({"some": df, "none": df.limit(0)}, str(tmp_path / "sheets")) == ["some"]


def test_plans(spark):
    rows = [(i, "en-de", f"source {i}.", f"Satz {i}.", "en", "de") for i in range(6)]
    clean = spark.createDataFrame(rows, "idx bigint, lp string, source string, reference string, src_lang string, tgt_lang string")
    built = benchmark_build.build_benchmark(clean.union(clean.limit(1)), per_pair=4)
    assert built.count() == 16 and built.where("label = 1").count() == 4 and built.where("translation is null").count() == 0
    items = clean.withColumn("translation", F.concat(F.lit("German: "), "reference"))
    assert methods.clean_method(items).where("language_correct and extracted_text = reference").count() == 6
    assert "predicted_noise_pattern" in methods.llm_method(items).columns
    results = items.selectExpr("idx", "idx as result_id", "'m' as method", "translation", "reference", "reference as extracted_text", "0 as label", "'formatting' as noise_category", "'language_prefix' as noise_pattern", "cast(null as string) as predicted_noise_pattern", "current_timestamp() as loaded_at")
    tables = evaluation.evaluate(results)
    assert tables["detection"].first().recall == 1.0 and tables["noise_prediction"].count() == 0
    assert "accuracy" in json.dumps(writers.nested_metrics(tables["extraction"].drop("total"))) and "m" in writers.text_table(tables["coverage"], "t", ["method"])
    labels = silver.label_items(items.withColumn("noise_patterns", F.array(F.lit("x"))), "ann").withColumns({"run_at": F.current_timestamp(), "loaded_at": F.current_timestamp()})
    assert silver.aggregate(labels, ["ann", "ann2", "ann3"]).where("silver_reference is null").count() == 6


def test_rulebase(spark):
    df = spark.createDataFrame([("m", "en-ru", "Привет мир", "Привет", "ru"), ("m", "en-ru", None, None, "ru"), ("n", "en-de", "Hallo Welt", "Hallo", "")], "model string, lp string, translation string, reference string, tgt_lang string")
    report = {(r.model, r.lp): (r.total, r.clean) for r in rulebase.with_overall(rulebase.summary(rulebase.classify(df), ["model", "lp"])).collect()}
    assert report == {("m", "en-ru"): (2, 1), ("m", "OVERALL"): (2, 1), ("n", "en-de"): (1, 1), ("n", "OVERALL"): (1, 1)}


def test_stream(spark, tmp_path):
    from palimpsest.streaming import classify_stream, clean_stream

    df = spark.createDataFrame([("[[x]]", "x", "de")], "translation string, reference string, tgt_lang string")
    df.write.parquet(str(tmp_path / "in"))
    stream = classify_stream(clean_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))))
    query = stream.writeStream.format("memory").queryName("classified").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.sql("select cleaned from classified").first().cleaned == "x"


def test_null_languages_give_texts(spark):
    rows = [(i, "en-de", None if i % 3 == 0 else f"s{i}", f"r{i}", None if i % 2 else "en", None if i % 4 else "de") for i in range(24)]
    clean = spark.createDataFrame(rows, "idx bigint, lp string, source string, reference string, src_lang string, tgt_lang string")
    built = benchmark_build.build_benchmark(clean, per_pair=None)
    assert built.count() == 96 and built.where("translation is null").count() == 0

    class Broken:
        def create(self, messages, max_tokens, **options):
            raise OSError

    failed = noise.fill_content(noise.variants(clean).where("variant > 0"), F.lit(None).cast("string"))
    assert failed.where("noisy_translation is null").count() == 0 and failed.where("variant = 1").select("noise_pattern").distinct().collect()[0][0] == noise.FAILED_PATTERN
    single = benchmark_build.single_noise(clean, ["explanation", "code_block"])
    assert single.count() == 24 and single.where("noisy_translation is null").count() == 0 and {r[0] for r in single.select("noise_pattern").distinct().collect()} == {"explanation", "code_block"}
    with pytest.raises(ValueError):
        noise.single(clean, ["unheard"])


def test_provider_text_is_kept(spark):
    class Tagged:
        def create(self, messages, max_tokens, **options):
            return ['<think>x</think>{"a": 1}' for _ in messages]

    clean = spark.createDataFrame([(1, "en-de", "s", "r", "en", "de")], "idx bigint, lp string, source string, reference string, src_lang string, tgt_lang string")
    assert benchmark_build.build_benchmark(clean, provider=Tagged).where("noise_category = 'content'").first().translation == '<think>x</think>{"a": 1}'


def test_retry_and_http(spark):
    import http.server
    import threading

    class Second:
        asked = 0

        def create(self, messages, max_tokens, **options):
            Second.asked += 1
            if Second.asked == 2:
                raise OSError
            return [f"try {Second.asked}" if m[-1]["content"] == "no" else "yes" for m in messages]

    df = spark.createDataFrame([(1, [("user", "no")]), (2, [("user", "ok")])], "idx int, messages array<struct<role:string,content:string>>").coalesce(1)
    got = {r.idx: r.raw_response for r in complete(df, "messages", Second, wait=0, accept=lambda t: t == "yes").collect()}
    assert got == {1: "try 3", 2: "yes"}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = json.dumps({"choices": [{"message": {"content": f"{body['messages'][-1]['content']} {body['temperature']}"}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(said)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    factory = provider_factory("http", url=f"http://127.0.0.1:{server.server_port}/", model="m", key="k")
    assert {r.raw_response for r in complete(df, "messages", factory, temperature=0.0).collect()} == {"no 0.0", "ok 0.0"}
    server.shutdown()
    with pytest.raises(ValueError):
        provider_factory("unheard")


def test_language_model_in_the_rules(spark):
    assert [standard_code(x) for x in ("__label__iw", "zh-cn", "de", None)] == ["he", "zh", "de", None]

    class Model:
        def detect(self, texts):
            if "raise" in texts[0]:
                raise RuntimeError
            return [("__label__fr", 0.95)] * len(texts)

    df = spark.createDataFrame([("Bonjour tout le monde", "fr"), ("Bonjour tout le monde", "de"), (None, "fr")], "translation string, tgt_lang string").withColumn("reference", F.lit("x"))
    got = [(r.wrong_language, r.detected_lang) for r in rulebase.classify(df, "tgt_lang", Model).collect()]
    assert got == [(False, "fr"), (True, "fr"), (True, None)]
    raised = rulebase.classify(spark.createDataFrame([("raise it", "x", "en")], "translation string, reference string, tgt_lang string"), "tgt_lang", Model).first()
    assert (raised.wrong_language, raised.detected_lang, raised.confidence) == (False, None, 0.0)


def test_ordering(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.randrange(-50, 5000), rng.choice(["a", None]), k) for k in range(300)]
    df = spark.createDataFrame(rows, "idx bigint, lp string, k int").dropDuplicates(["idx"])
    got = splits.ordinals(df, "lp", "idx").collect()
    for name in ("a", None):
        assert [r.ordinal for r in sorted((r for r in got if r.lp == name), key=lambda r: r.idx)] == list(range(sum(r.lp == name for r in got)))
    assert splits.ordinals(df.limit(0), "lp", "idx").count() == 0 and splits.stratified_split(df.limit(0), "lp", "idx").count() == 0
    plan = splits.stratified_split(df, "lp", "idx")._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan


def test_lines_have_places(spark, tmp_path):
    texts = [f'{{"a": {k}, "t": "{"x" * 90}"}}' for k in range(500)]
    (tmp_path / "big.jsonl").write_text("\n\n".join(texts) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.read_jsonl(spark, str(tmp_path / "big.jsonl"), "a int, t string", key="place").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.place, r.a) for r in got) == [(k, k) for k in range(500)]
    assert readers.read_jsonl(spark, str(tmp_path / "big.jsonl"), key="place").columns == ["place", "a", "t"]


def test_evaluation_of_files(spark, tmp_path):
    bench = [{"source": "s", "translation": f"t{k}", "silver_reference": f"t{k}", "perturbation_type": "content"} for k in range(4)]
    write = lambda name, rows: (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    write("b.jsonl", bench)
    write("fits.jsonl", [{"extracted_text": r["translation"] if k else None} for k, r in enumerate(bench)])
    write("short.jsonl", [{"extracted_text": "x"}])
    paths = [str(tmp_path / n) for n in ("fits.jsonl", "short.jsonl", "absent.jsonl")]
    mode, tables, left_out = evaluation.evaluate_files(spark, str(tmp_path / "b.jsonl"), paths, out=str(tmp_path / "metrics.json"))
    assert mode == "curated" and left_out == paths[1:]
    assert {r.category: (r.correct, r.total) for r in tables["extraction"].collect()} == {"content": (3, 4), "noisy_only": (3, 4), "all": (3, 4)}
    assert json.loads((tmp_path / "metrics.json").read_text())["num_instances"] == 4
    write("bare.jsonl", [{"translation": "t"}])
    write("one.jsonl", [{"extracted_text": "t"}])
    assert "extraction" not in evaluation.evaluate_files(spark, str(tmp_path / "bare.jsonl"), [str(tmp_path / "one.jsonl")])[1]
    with pytest.raises(ValueError):
        evaluation.evaluate_files(spark, str(tmp_path / "b.jsonl"), paths[1:])


def test_baseline_tree(spark, tmp_path):
    for model, pair, name, lines in (("m", "English-German", "test_translations.jsonl", ['{"translation": "Привет мир", "reference": "x"}']), ("m", "English-German", "test_translations_original.jsonl", ['{"translation": "Hallo Welt", "reference": "x"}', "broken", "", '{"translation": "Hallo", "reference": "y", "tgt_lang": "ru"}']), ("x-thinking", "English-Russian", "test_translations_original.jsonl", ['{"translation": "a"}'])):
        (tmp_path / "tree" / model / pair).mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / model / pair / name).write_text("\n".join(lines))
    table = baseline.run(spark, str(tmp_path / "tree"), str(tmp_path / "report.txt"), str(tmp_path / "labels"), pairs=["English-German", "English-Russian"])
    got = {(r.model, r.lp): (r.total, r.clean, r.wrong_language) for r in table.collect()}
    assert got[("m", "English-German")] == (2, 1, 1) and got[("m", "English-Russian")] == (0, 0, 0) and got[("m", "OVERALL")] == (2, 1, 1) and got[("x-thinking", "OVERALL")] == (0, 0, 0)
    report = (tmp_path / "report.txt").read_text()
    assert "Model: m" in report and "50.00%" in report and "Comparison of models" in report
    back = spark.read.csv(str(tmp_path / "labels"), sep="\t", header=True)
    assert sorted(r["index"] for r in back.collect()) == ["0", "1"]
    (tmp_path / "none").mkdir()
    assert baseline.run(spark, str(tmp_path / "none"), pairs=["English-German"]).count() == 0


def test_fixed_values():
    """Written out once more, as the SQL shares the library's own constants."""
    assert noise.FORMATTING_WEIGHTS == {"language_prefix": 7, "verbose_preamble": 9, "translation_prefix": 1, "code_block": 3, "special_formatting": 2, "extra_punctuation": 3}
    assert noise.CONTENT_WEIGHTS == {"explanation": 33, "cultural_note": 1, "bilingual_output": 7, "alternatives": 15, "wrong_language": 7, "off_topic": 12}
    assert {text.PATTERN_CATEGORY[p] for p in noise.FORMATTING_WEIGHTS} == {"formatting"} and {text.PATTERN_CATEGORY[p] for p in noise.CONTENT_WEIGHTS} == {"content"}
    assert text.PATTERN_CATEGORY["none"] == "clean" and len(text.PATTERN_CATEGORY) == 13
    assert len(explanations.EXPLANATION_PATTERNS) == 16 and len(readers.PAIRS) == 22 and len(prompts.LANGUAGE_NAMES) == 17
    assert (prompts.TRANSLATION_LIMIT, prompts.SOURCE_LIMIT, prompts.REFERENCE_LIMIT) == (10_000, 5_000, 5_000) and spans.MOST_LINES == 20 and spans.LEAST_COVERAGE == 0.8


def test_reader_golden_rows():
    assert parsing.read_result('```json\n{"extracted_translation": "a", "noise_pattern": "none"}\n```') == ("a", "none")
    assert parsing.read_result('{"extracted_translation": "a \\"b", "noise_pattern": "x",}') == ('a \\"b', "x")
    assert parsing.read_result('{"extracted_translation": „a“, "noise_pattern": "x"') == ("a", "x")
    assert parsing.read_result("plain") == ("plain", None) and parsing.read_result(None) == (None, None)
    assert parsing.read_silver("<think>{}</think> {\"extracted_translation\": null}") == (None, None)
    assert parsing.read_silver('thinking:\nso\n\n{"extracted_translation": ["a", "b"]}')[0] == "a"
    assert parsing.read_extractor("<think>x</think>\n\n y ") == ("y", None) and parsing.read_extractor("Thinking Process:\n1\n\nlast") == ("last", None)
