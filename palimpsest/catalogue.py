"""Queries of the core operators over the project's tables, and SQL that gives the same rows. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cleanup, explanations, models, parsing, prompts, scripts, text
from .operators import align, metrics, noise, rulebase, spans, splits, votes
from .plans import baseline, benchmark_build, evaluation, methods, silver
from .session import scratch_path
from .sources import readers, writers

VOTERS = ["ann-fathom-xl", "ann-corvid-l", "ann-marl-l"]
C = F.col


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _benchmark(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Distinct rows of the needed columns."""
    return _read(spark, d, "benchmark").select("idx", *columns).distinct()


def _outputs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _read(spark, d, "model_output").select("out_id", F.lower(F.trim("model")).alias("model"), "lp", *columns)


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "clean_sample").distinct()


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluation_rows(_read(spark, d, "llm_result"))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return silver.votes_table(_read(spark, d, "silver_label"), VOTERS)


def text_normalized(spark: SparkSession, d: str) -> DataFrame:
    return _benchmark(spark, d, "reference", "translation").select("idx", text.normalize_text(C("reference")).alias("reference"), text.normalize_text(C("translation")).alias("translation"))


def text_labels(spark: SparkSession, d: str) -> DataFrame:
    made = text.synthetic_label(C("translation"), C("reference"))
    return _read(spark, d, "benchmark").select(
        "idx", made["label"].alias("synthetic_label"), made["match"].alias("exact_match"), F.round(text.coverage(C("reference"), C("translation")), 9).alias("coverage"),
        text.curated_label(C("reference"), C("translation")).alias("curated_label"), text.detection_label(C("reference"), C("translation")).alias("detection_label"),
    ).distinct()


def text_noise_category(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "benchmark").select("idx", text.noise_category(C("noise_pattern")).alias("category"), text.gold_is_noisy(C("label")).alias("is_noisy")).distinct()


def cleanup_steps(spark: SparkSession, d: str) -> DataFrame:
    t = C("translation")
    return _benchmark(spark, d, "translation").select(
        "idx", cleanup.strip_code_block(t).alias("no_fence"), cleanup.strip_special_formatting(t).alias("no_brackets"), cleanup.strip_language_prefix(t).alias("no_prefix"), cleanup.strip_extra_punctuation(t).alias("no_marks"), cleanup.clean_formatting(t).alias("cleaned")
    )


def explanation_flags(spark: SparkSession, d: str) -> DataFrame:
    return _outputs(spark, d, "translation", "reference").select("out_id", explanations.contains_explanation(C("translation"), C("reference")).alias("has_explanation")).distinct()


def script_check(spark: SparkSession, d: str) -> DataFrame:
    shares = scripts.script_shares(C("translation"))
    share = lambda n: F.round(F.coalesce(F.try_element_at(shares, F.lit(n)), F.lit(0.0)), 9)
    return _outputs(spark, d, "translation").select("out_id", *[share(n.upper()).alias(n) for n in ("latin", "cyrillic", "arabic", "han", "hangul")], scripts.is_correct_language(C("translation"), F.substring_index("lp", "-", -1)).alias("language_ok")).distinct()


def _classified(spark: SparkSession, d: str) -> DataFrame:
    rows = _outputs(spark, d, "translation", "reference").withColumn("target", F.substring_index("lp", "-", -1))
    return rulebase.classify(rows, "target").drop("translation", "reference", "target").distinct()


def rule_instances(spark: SparkSession, d: str) -> DataFrame:
    return writers.instance_table(_classified(spark, d).withColumnRenamed("out_id", "index"))


def rule_report(spark: SparkSession, d: str) -> DataFrame:
    return rulebase.with_overall(rulebase.summary(_classified(spark, d), ["model", "lp"]))


def rule_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rulebase.ranking(rulebase.summary(_classified(spark, d), ["model"])).select("place", "model", "total", "clean", "clean_rate")


def rule_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    """Rows and clean rows of every model and pair, with zeros where a model has no output for a pair."""
    rows = _outputs(spark, d, C("translation").isNull().alias("gone")).distinct()
    # as many rows as models x pairs, a report's size
    grid = rows.select("model").distinct().crossJoin(rows.select("lp").distinct())
    found = rows.groupBy("model", "lp").agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(C("gone"), 1).otherwise(0)).alias("missing"))
    return align.zero_fill(grid, found, ["model", "lp"])


def align_results(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark rows with the results of each method, aligned by key; a result's text wins."""
    results = align.latest(_read(spark, d, "llm_result").select("result_id", "idx", "method", F.coalesce(F.length("extracted_text"), F.lit(0)).alias("n_extracted"), "coverage", "loaded_at"), ["result_id"], ["loaded_at"])
    joined = align.align(_benchmark(spark, d, "lp", F.coalesce(F.length("translation"), F.lit(0)).alias("n_translation")), results.drop("loaded_at"))
    return joined.select("result_id", "idx", "lp", "method", "n_translation", "n_extracted", "coverage")


def eval_mode(spark: SparkSession, d: str) -> DataFrame:
    return metrics.evaluation_mode(_read(spark, d, "benchmark"))


def eval_detection(spark: SparkSession, d: str) -> DataFrame:
    return metrics.binary_metrics(_rows(spark, d), "is_noisy", "pred", ["method"])


def eval_detection_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return metrics.category_breakdown(_rows(spark, d), "is_noisy", "pred", "noise_category", ["method"])


def eval_extraction(spark: SparkSession, d: str) -> DataFrame:
    return metrics.extraction_metrics(_rows(spark, d), "match", "noise_category", ["method"])


def eval_coverage(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_coverage(_rows(spark, d), "cover", ["method"]).withColumn("avg_coverage", F.round("avg_coverage", 6))


def eval_noise_prediction(spark: SparkSession, d: str) -> DataFrame:
    return metrics.noise_prediction(_rows(spark, d), "is_noisy", "predicted_pattern", "noise_pattern", "noise_category", ["method"])


def eval_confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.category_confusion(_rows(spark, d), "is_noisy", "predicted_pattern", "noise_category", ["method"])


def vote_majority(spark: SparkSession, d: str) -> DataFrame:
    made = votes.majority_vote([C(f"vote_{k}") for k in range(3)])
    return _votes(spark, d).select("idx", made["text"].alias("chosen"), made["agreement"].alias("agreement"))


def vote_silver_reference(spark: SparkSession, d: str) -> DataFrame:
    made = votes.silver_reference(_votes(spark, d), [f"vote_{k}" for k in range(3)], VOTERS)
    return made.select("idx", "silver_reference", "silver_agreement", F.array_join("silver_votes", "|").alias("silver_votes"), F.array_join("silver_models", "|").alias("silver_models"))


def vote_agreement(spark: SparkSession, d: str) -> DataFrame:
    return votes.agreement_distribution(vote_majority(spark, d), "agreement")


def vote_inspection(spark: SparkSession, d: str) -> DataFrame:
    none, ties = votes.inspection_rows(vote_majority(spark, d), "chosen", "agreement")
    return none.select("idx", F.lit("no_extraction").alias("sheet"), "chosen").unionByName(ties.select("idx", F.lit("tie_break").alias("sheet"), "chosen"))


def silver_success(spark: SparkSession, d: str) -> DataFrame:
    last = align.latest(_read(spark, d, "silver_label").select("idx", "silver_model", "run_at", "loaded_at", "silver_extracted_translation"), ["idx", "silver_model"], ["run_at", "loaded_at"])
    return votes.extraction_success(last, "silver_extracted_translation", ["silver_model"])


def split_stratified(spark: SparkSession, d: str) -> DataFrame:
    return splits.stratified_split(_clean(spark, d).select("idx", "lp"), "lp", "idx")


def split_ids(spark: SparkSession, d: str) -> DataFrame:
    numbered = splits.ordinals(_clean(spark, d).select("idx", "lp"), "lp", "idx")
    return numbered.select("idx", splits.entry_id(C("lp"), C("ordinal"), F.lit("clean")).alias("id"))


def split_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: twenty rows a pair by hash."""
    return splits.sample_per_group(_clean(spark, d).select("idx", "lp"), "lp", "idx", 20)


def split_statistics(spark: SparkSession, d: str) -> DataFrame:
    return splits.benchmark_statistics(_benchmark(spark, d, F.lower(F.trim("split")).alias("split"), "label", "noise_category", "lp"))


def noise_distribution(spark: SparkSession, d: str) -> DataFrame:
    return noise.pattern_distribution(_benchmark(spark, d, "noise_pattern"), "noise_pattern")


def noise_variants(spark: SparkSession, d: str) -> DataFrame:
    """Drawn patterns of the three variants of each clean record, and the text of the rule-based ones."""
    made = noise.variants(_clean(spark, d))
    return made.select("clean_idx", "variant", "noise_category", "noise_pattern", "noisy_translation")


def noise_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a benchmark built from the whole clean sample with the stand-in provider."""
    return benchmark_build.build_benchmark(_read(spark, d, "clean_sample"), per_pair=None)


def span_counts(spark: SparkSession, d: str) -> DataFrame:
    return _benchmark(spark, d, "translation").select("idx", F.size(spans.lines_of(C("translation"))).alias("n_lines"), F.size(spans.spans_of(C("translation"))).alias("n_spans"))


def span_best(spark: SparkSession, d: str) -> DataFrame:
    """The span whose length is nearest to the source's (native score), first on a tie."""
    rows = spans.explode_spans(_benchmark(spark, d, "translation", F.length("source").alias("n_source")), "translation", ["idx", "n_source"])
    scored = rows.withColumn("score", F.least(F.length("span"), C("n_source")) / F.greatest(F.length("span"), C("n_source"), F.lit(1)))
    return spans.best_span(scored, ["idx"], "score").withColumn("best_score", F.round("best_score", 9))


def span_clean_method(spark: SparkSession, d: str) -> DataFrame:
    """Best span by the stand-in scorer, cleaned and checked for language."""
    return methods.clean_method(_benchmark(spark, d, "source", "translation", "tgt_lang")).select("idx", "extracted_text", F.round("coverage", 6).alias("coverage"), "language_correct")


def prompt_silver(spark: SparkSession, d: str) -> DataFrame:
    made = prompts.silver_prompt(*[C(c) for c in ("translation", "source", "reference", "src_lang", "tgt_lang", "noise_patterns")])
    return _read(spark, d, "curated").distinct().select("idx", made.alias("prompt"))


def prompt_noise(spark: SparkSession, d: str) -> DataFrame:
    made = prompts.noise_messages(F.substring_index("noise_pattern", "+", 1), C("source"), C("reference"), C("src_lang"), C("tgt_lang"))
    return _benchmark(spark, d, "noise_pattern", "source", "reference", "src_lang", "tgt_lang").select("idx", F.size(made).alias("n_messages"), F.element_at(made, -1)["content"].alias("request"))


def parse_results(spark: SparkSession, d: str) -> DataFrame:
    rows = align.latest(_read(spark, d, "llm_result").select("result_id", "loaded_at", "extracted_text"), ["result_id"], ["loaded_at"])
    return rows.withColumn("p", parsing.parse_result(C("extracted_text"))).select("result_id", "p.extracted", "p.noise_pattern")


def parse_raw_outputs(spark: SparkSession, d: str) -> DataFrame:
    rows = align.latest(_read(spark, d, "llm_result").select("result_id", "loaded_at", "raw_llm_output", "translation"), ["result_id"], ["loaded_at"])
    made = rows.withColumn("p", parsing.parse_extractor(C("raw_llm_output"), C("translation")))
    return made.select("result_id", "p.extracted_text", "p.predicted_noise_pattern", F.round("p.coverage", 6).alias("coverage"))


def parse_silver_responses(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "silver_label").select("idx", "silver_model", "run_at", "silver_raw_response").distinct()
    return rows.select("idx", "silver_model", "run_at", parsing.parse_silver(C("silver_raw_response")).alias("extracted"))


def source_methods(spark: SparkSession, d: str) -> DataFrame:
    """Method names read off result paths."""
    paths = _read(spark, d, "llm_result").select("method", "lp").distinct().select(F.concat(F.lit("out/results/"), "method", F.lit("/"), "lp", F.lit("/test.jsonl")).alias("path"))
    return paths.select("path", readers.method_name(C("path")).alias("name"))


def text_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Characters of the translations by their script."""
    chars = _benchmark(spark, d, "translation").select(F.explode(F.split(C("translation"), "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return chars.groupBy(scripts.character_script(C("c")).alias("script")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"))


def _named_pair() -> F.Column:
    return F.concat(prompts.language_name(F.substring_index("lp", "-", 1)), F.lit("-"), prompts.language_name(F.substring_index("lp", "-", -1)))


def _plain_folders(spark: SparkSession, root: str, depth: int) -> str:
    """Renames folders ``name=value`` of a partitioned write to ``value``."""
    system = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, folder in readers._listing(spark, root):
        if folder and "=" in name:
            value = f"{root}/{name.split('=', 1)[1]}"
            system.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}"), spark._jvm.org.apache.hadoop.fs.Path(value))
            if depth > 1:
                _plain_folders(spark, value, depth - 1)
    return root


def _tree(spark: SparkSession, d: str) -> tuple[str, list[str]]:
    """The outputs of all models as a tree ``model/pair/test_translations.jsonl`` with a broken and a blank line in each file, and
    the pairs."""
    rows = _outputs(spark, d, "translation", "reference").distinct().withColumn("pair", _named_pair())
    value = F.explode(F.array(F.to_json(F.struct("translation", "reference"), {"ignoreNullFields": "false"}), F.when(C("out_id") % 7 == 0, '{"translation": "cut').otherwise(" ")))
    root = scratch_path(spark)
    rows.select("model", "pair", F.lit("test_translations.jsonl").alias("file"), value.alias("value")).write.partitionBy("model", "pair", "file").text(root)
    return _plain_folders(spark, root, 3), sorted(r.pair for r in rows.select("pair").distinct().collect())


def drive_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The rule report of a tree of model outputs, read as files."""
    root, pairs = _tree(spark, d)
    return baseline.run(spark, root, pairs=pairs)


def source_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Models, pairs, files and target languages of the tree."""
    root, pairs = _tree(spark, d)
    files = readers.translation_files(spark, root, readers.discover_models(spark, root), pairs, "test")
    return spark.createDataFrame([(m, lp, p.rsplit("/", 1)[1], readers.target_language_of_path(p)) for m, lp, p in files], "model string, lp string, file string, tgt_lang string")


def sink_report(spark: SparkSession, d: str) -> DataFrame:
    """Table and comparison lines of the text report."""
    table = rule_report(spark, d)
    return writers.baseline_lines(table).unionByName(writers.ranking_lines(table).select(F.lit("").alias("lp"), "model", "line"))


def sink_confusion(spark: SparkSession, d: str) -> DataFrame:
    return writers.confusion_lines(eval_confusion(spark, d))


def sink_instances(spark: SparkSession, d: str) -> DataFrame:
    """The instance TSVs, written and read back."""
    path = scratch_path(spark)
    writers.write_instances(_classified(spark, d).withColumnRenamed("out_id", "index"), path)
    back = spark.read.csv(path, sep="\t", header=True, schema="index bigint, clean int, has_explanation int, wrong_language int, detected_lang string, confidence string, model string, lp string")
    return back.select("model", "lp", "index", "clean", "has_explanation", "wrong_language", F.coalesce("detected_lang", F.lit("")).alias("detected_lang"), "confidence")


def sink_results(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark rows with result fields as JSON lines, written and read back; the result's translation wins."""
    path, columns = scratch_path(spark), ("lp", "translation", "noise_pattern")
    results = _read(spark, d, "llm_result").groupBy("idx").agg(F.count(F.lit(1)).alias("n_results"), F.max("extracted_text").alias("translation"))
    writers.write_results(_benchmark(spark, d, *columns), results, path)
    return readers.read_jsonl(spark, path, "idx bigint, lp string, translation string, noise_pattern string, n_results bigint")


def sink_inspection(spark: SparkSession, d: str) -> DataFrame:
    """The inspection sheets, written and read back."""
    path = scratch_path(spark)
    none, ties = votes.inspection_rows(vote_majority(spark, d), "chosen", "agreement")
    written = writers.write_inspection({"no_extraction": none, "tie_break": ties, "nothing": none.limit(0)}, path)
    sheets = [spark.read.csv(f"{path}/{name}", header=True, escape='"', multiLine=True, schema="idx bigint, chosen string, agreement int").select("idx", F.lit(name).alias("sheet"), "agreement") for name in written]
    return reduce(DataFrame.unionByName, sheets)


def sink_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metrics JSON, written and read back."""
    path = scratch_path(spark)
    writers.write_metrics(eval_extraction(spark, d), path)
    value = "map<string,map<string,struct<correct:bigint,total:bigint,accuracy:double>>>"
    read = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", value)).alias("method", "v"))
    return read.select("method", F.explode("v").alias("category", "m")).select("method", "category", "m.correct", "m.total", "m.accuracy")


def _sorted_lines(spark: SparkSession, d: str) -> str:
    path = scratch_path(spark)
    writers.write_jsonl(_benchmark(spark, d, "lp", "source", "translation").orderBy("idx"), path)
    return path


def source_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines with the place of each line."""
    return readers.read_jsonl(spark, _sorted_lines(spark, d), "idx bigint, lp string, source string, translation string", key="place")


def source_first_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred lines (the feature)."""
    return readers.first_rows(readers.read_jsonl(spark, _sorted_lines(spark, d), "idx bigint, lp string", key="place"), 100, "place")


def source_tolerant(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines of which every fifth is broken, and blank ones."""
    path = scratch_path(spark)
    whole = F.to_json(F.struct("idx", "translation"), {"ignoreNullFields": "false"})
    rows = _benchmark(spark, d, "translation").orderBy("idx")
    rows.select(F.explode(F.array(F.when(C("idx") % 5 == 0, F.concat(F.lit("x"), whole)).otherwise(whole), F.lit("  "))).alias("value")).write.text(path)
    return readers.read_jsonl(spark, path, "idx bigint, translation string", tolerant=True, key="place")


def source_tsv(spark: SparkSession, d: str) -> DataFrame:
    """A TSV whose texts have escaped line breaks."""
    path = f"{scratch_path(spark)}.tsv"
    escaped = [F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit("\\n")).alias(c) for c in ("source", "reference")]
    _clean(spark, d).select("idx", *escaped).write.csv(path, sep="\t", header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_input(spark, path).select(C("idx").cast("bigint").alias("idx"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("reference", F.lit("")).alias("reference"))


def source_reuse(spark: SparkSession, d: str) -> DataFrame:
    """A step that is made once and read the second time."""
    path = scratch_path(spark)
    readers.reuse_or(spark, path, lambda: splits.sample_per_group(_clean(spark, d).select("idx", "lp"), "lp", "idx", 20))
    return readers.reuse_or(spark, path, lambda: _clean(spark, d).select("idx", "lp").limit(0), skip=True)


def drive_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Detection and extraction by method of result files aligned line by line with a benchmark file; a file that lacks a line is
    left out."""
    root = scratch_path(spark)
    bench = _benchmark(spark, d, "source", "reference", "translation", "label", "noise_category", "noise_pattern")
    writers.write_jsonl(bench.orderBy("idx"), f"{root}/benchmark.jsonl")
    fields = ["method", "idx", "loaded_at", "result_id", "extracted_text", "predicted_noise_pattern"]
    last = align.latest(_read(spark, d, "llm_result").select(*fields), ["method", "idx"], ["loaded_at", "result_id"])
    paths = []
    for name in sorted(r.method for r in last.select("method").distinct().collect()):
        mine = bench.select("idx").join(last.where(C("method") == name), "idx", "left").select("idx", "extracted_text", "predicted_noise_pattern").orderBy("idx")
        paths.append(f"{root}/results/{name}/all.jsonl")
        writers.write_jsonl(mine, paths[-1])
    short = f"{root}/results/short/all.jsonl"
    writers.write_jsonl(spark.read.json(paths[0]).where("idx > 0"), short) if paths else None
    mode, tables, left_out = evaluation.evaluate_files(spark, f"{root}/benchmark.jsonl", [*paths, short, f"{root}/results/absent/all.jsonl"])
    found = tables["detection"].join(tables["extraction"].where("category = 'all'").select("method", "correct", C("accuracy").alias("extraction_accuracy")), "method")
    return found.withColumns({"mode": F.lit(mode), "n_left_out": F.lit(len(left_out))})


def eval_curated(spark: SparkSession, d: str) -> DataFrame:
    """Extraction against the silver reference of a curated set: each annotator's labels as a method."""
    silver_rows = vote_silver_reference(spark, d).select("idx", "silver_reference")
    last = align.latest(_read(spark, d, "silver_label").select("idx", "silver_model", "run_at", "loaded_at", "silver_extracted_translation", "translation"), ["idx", "silver_model"], ["run_at", "loaded_at"])
    rows = last.join(silver_rows, "idx").select(C("idx").alias("result_id"), C("silver_model").alias("method"), C("silver_extracted_translation").alias("best_span"), F.lit(None).cast("string").alias("extracted_text"), "translation", "silver_reference", F.lit("content").alias("perturbation_type"))
    return metrics.extraction_metrics(evaluation.evaluation_rows(rows, "curated"), "match", "noise_category", ["method"])


def drive_noise(spark: SparkSession, d: str) -> DataFrame:
    """One drawn pattern a record, by rule or by the stand-in provider."""
    return benchmark_build.single_noise(_clean(spark, d)).select("idx", "noise_pattern", "noisy_translation")


def drive_noise_rules(spark: SparkSession, d: str) -> DataFrame:
    """The same among rule-based patterns only, as a distribution."""
    return noise.pattern_distribution(benchmark_build.single_noise(_clean(spark, d), rules_only=True), "noise_pattern")


def drive_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the build read back from its dev and test files; the second call uses the steps of the first."""
    folder = scratch_path(spark)
    benchmark_build.build_to(_read(spark, d, "clean_sample"), folder, per_pair=None)
    return benchmark_build.build_to(_read(spark, d, "clean_sample").limit(0), folder, per_pair=None, skip_sampling=True, skip_generation=True)


def drive_silver(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the curated set by the stand-in annotator."""
    return silver.label_items(_read(spark, d, "curated").distinct(), "echo").select("idx", "silver_model", "silver_extracted_translation", "silver_raw_response")


class SecondTry(models.EchoProvider):
    """Stand-in: cannot be read at the first try, and never for texts with a bracket."""

    def __init__(self):
        self.asked = 0

    def create(self, messages: list[list[dict]], max_tokens: int, **options) -> list[str]:
        self.asked += 1
        said = super().create(messages, max_tokens, **options)
        return [f"{options['mark']}{self.asked}" if self.asked == 1 or "[" in m[-1]["content"] else text for m, text in zip(messages, said, strict=True)]


def model_retry(spark: SparkSession, d: str) -> DataFrame:
    """Items whose answer could not be read after all tries, with the last raw answer, and how many could."""
    made = silver.label_items(_read(spark, d, "curated").distinct().coalesce(1), "again", SecondTry, wait=0.0, mark="try ")
    return made.groupBy(C("silver_extracted_translation").isNotNull().alias("was_read")).agg(F.count(F.lit(1)).alias("n"))


def model_chat(spark: SparkSession, d: str) -> DataFrame:
    """The extractor's plan with the stand-in provider."""
    made = methods.llm_method(_benchmark(spark, d, "source", "translation"))
    return made.select("idx", "extracted_text", "predicted_noise_pattern", F.round("coverage", 6).alias("coverage"))


def model_spans(spark: SparkSession, d: str) -> DataFrame:
    """The best span by the stand-in scorer and its label."""
    return methods.span_method(_benchmark(spark, d, "source", "translation")).select("idx", "best_span", F.round("qe_score", 9).alias("qe_score"), "label")


def model_language(spark: SparkSession, d: str) -> DataFrame:
    """The rule report with a language model (the stand-in) before the scripts."""
    rows = _outputs(spark, d, "translation", "reference").withColumn("target", F.substring_index("lp", "-", -1))
    classified = rulebase.classify(rows, "target", models.ScriptLanguageModel).select("out_id", "model", "detected_lang", "confidence", "wrong_language").distinct()
    return classified.groupBy("model", "detected_lang").agg(F.count(F.lit(1)).alias("n"), F.sum(C("wrong_language").cast("bigint")).alias("wrong"), F.max("confidence").alias("confidence"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        text_normalized, text_labels, text_noise_category, cleanup_steps, explanation_flags, script_check, rule_instances, rule_report, rule_ranking,
        rule_zero_filled, align_results, eval_mode, eval_detection, eval_detection_breakdown, eval_extraction, eval_coverage, eval_noise_prediction,
        eval_confusion, vote_majority, vote_silver_reference, vote_agreement, vote_inspection, silver_success, split_stratified, split_ids, split_sample,
        split_statistics, noise_distribution, noise_variants, noise_benchmark, span_counts, span_best, span_clean_method, prompt_silver, prompt_noise,
        parse_results, parse_raw_outputs, parse_silver_responses, source_methods, source_jsonl, source_first_rows, source_tolerant, source_tsv, source_reuse,
        source_discovery, sink_results, sink_instances, sink_inspection, sink_report, sink_confusion, sink_metrics, text_scripts, eval_curated, model_chat,
        model_spans, model_retry, model_language, drive_baseline, drive_evaluation, drive_noise, drive_noise_rules, drive_benchmark, drive_silver,
    )
}


# --- SQL -------------------------------------------------------------------------------------------------------------


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}\x1c-\x1f\x{{85}}]+|[\s\p{{Z}}\x1c-\x1f\x{{85}}]+$', '', 'g')"


def _norm(x: str) -> str:
    return f"nfc_normalize({_strip(f'coalesce({x}, {chr(39) * 2})')})"


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _cover(a: str, b: str) -> str:
    return f"(CASE WHEN length({_strip(f'coalesce({b}, {chr(39) * 2})')}) = 0 THEN 1.0 ELSE length({_strip(f'coalesce({a}, {chr(39) * 2})')})::DOUBLE / length({_strip(f'coalesce({b}, {chr(39) * 2})')}) END)"


_B = "WITH b AS (SELECT DISTINCT * FROM benchmark)"
_O = "WITH o AS (SELECT DISTINCT * REPLACE (lower(trim(model)) AS model), split_part(lp, '-', 2) AS target FROM model_output)"
_CATEGORY = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.PATTERN_CATEGORY.items()) + " END"
_NO_FENCE = (
    f"(SELECT CASE WHEN starts_with(s, '```') AND ends_with(s, '```') AND len(l) >= 2 THEN {_strip('array_to_string(l[2:(CASE WHEN ' + _strip('l[-1]') + chr(32) + '= ' + _lit('```') + ' THEN len(l) - 1 ELSE len(l) END)], chr(10))')} ELSE s END "
    "FROM (SELECT s, string_split(s, chr(10)) AS l FROM (SELECT {strip} AS s)))"
)


def _fence(x: str) -> str:
    return _NO_FENCE.replace("{strip}", _strip(x))


def _brackets(x: str) -> str:
    s = _strip(x)
    inner = _strip(f"substr({s}, 3, greatest(length({s}) - 4, 0))")
    return f"(CASE WHEN (starts_with({s}, '[[') AND ends_with({s}, ']]')) OR (starts_with({s}, '{{{{') AND ends_with({s}, '}}}}')) THEN {inner} ELSE {s} END)"


def _prefix(x: str) -> str:
    pattern = rf"(?i)\A(?:{cleanup.PREFIXES})[\s\p{{Z}}]*:[\s\p{{Z}}]*"
    return f"(CASE WHEN regexp_matches({x}, '{pattern}') THEN {_strip(f'regexp_replace({x}, {_lit(pattern)}, {chr(39) * 2})')} ELSE {x} END)"


def _marks(x: str) -> str:
    return rf"regexp_replace({x}, '(?:(!)!{{2,}}|(\?)\?{{2,}})\n?$', '\1\2')"


_EXPLAINED = " OR ".join(
    [f"{_strip('coalesce(translation, ' + chr(39) * 2 + ')')} = ''"]
    + ["length(t) - length(replace(t, chr(10), '')) > 5", f"len(list_filter(string_split(t, chr(10) || chr(10)), lambda p: {_strip('p')} <> '')) > 2"]
    + ["""((starts_with(t, '"') OR starts_with(t, '''')) AND (ends_with(t, '"') OR ends_with(t, '''')) AND length(t) > 100 AND (length(t) - length(replace(t, '"', '')) > 2 OR length(t) - length(replace(t, '''', '')) > 2))"""]
    + [rf"len(list_filter(string_split(t, chr(10)), lambda l: contains(l, ':') AND len(list_filter(regexp_split_to_array({_strip('string_split(l, ' + _lit(':') + ')[1]')}, '[\s\p{{Z}}\x1c-\x1f]+'), lambda w: w <> '')) <= 3)) > 0"]
    + ["(n_ref > 50 AND length(t) > 2 * n_ref)"]
    + [f"regexp_matches(t, {_lit('(?im)' + p)})" for p in explanations.EXPLANATION_PATTERNS]
)
_BARE = r"regexp_replace(coalesce(translation, ''), '[\s\p{Z}\x1c-\x1f\x{85}]', '', 'g')"
_RANGES = {"latin": r"\x{0}-\x{24F}", "cyrillic": r"\x{400}-\x{4FF}", "arabic": r"\x{600}-\x{6FF}", "han": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}", "hangul": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}"}
_SHARES = ", ".join(f"(CASE WHEN n > 0 THEN length(regexp_replace(bare, '[^{r}]', '', 'g'))::DOUBLE / n ELSE 0.0 END) AS s_{k}" for k, r in _RANGES.items())
_KEPT = ", ".join(f"(CASE WHEN s_{k} >= 0.03 THEN s_{k} ELSE 0.0 END) AS {k}" for k in _RANGES)
_NAMES = " + ".join(f"({k} > 0)::INT" for k in _RANGES)
_OK = (
    "CASE WHEN coalesce(translation, '') = '' THEN false WHEN target NOT IN ('en','fr','it','de','cs','pl','ru','ar','zh','ko') THEN true "
    f"WHEN {_NAMES} = 0 THEN length({_strip('translation')}) < 10 "
    "WHEN (CASE WHEN target = 'ru' THEN cyrillic WHEN target = 'ar' THEN arabic WHEN target = 'zh' THEN han WHEN target = 'ko' THEN hangul + han ELSE latin END) < 0.6 THEN false "
    f"ELSE {_NAMES} <= 2 END"
)
_CLASSIFIED = f"""{_O},
    a AS (SELECT *, {_strip("coalesce(translation, '')")} AS t, length({_strip("coalesce(reference, '')")}) AS n_ref, {_BARE} AS bare FROM o),
    e AS (SELECT *, ({_EXPLAINED}) AS has_explanation, length(bare) AS n FROM a),
    f AS (SELECT *, {_SHARES} FROM e),
    g AS (SELECT *, {_KEPT} FROM f),
    h AS (SELECT *, ({_OK}) AS language_ok FROM g),
    k AS (SELECT *, NOT language_ok AS wrong_language, CASE WHEN has_explanation OR NOT language_ok THEN 0 ELSE 1 END AS clean FROM h)"""
_SUMMARY = "count(*) AS total, sum(clean)::BIGINT AS clean, (count(*) - sum(clean))::BIGINT AS with_issue, sum(has_explanation::INT)::BIGINT AS has_explanation, sum(wrong_language::INT)::BIGINT AS wrong_language"
_RATE_COLUMNS = ", ".join(f"{c}::DOUBLE / total AS {c}_rate" for c in ("clean", "with_issue", "has_explanation", "wrong_language"))
_FOLLOWED = r'(?s)"extracted_translation"\s*:\s*"((?:[^"\\]|\\.)*)"\s*[,\n]?\s*"noise_pattern'
_RESULTS = f"""WITH last AS (SELECT * FROM llm_result QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC) = 1),
    p AS (SELECT *, CASE WHEN regexp_matches(extracted_text, {_lit(_FOLLOWED)}) THEN {_strip(f'regexp_extract(extracted_text, {_lit(_FOLLOWED)}, 1)')} ELSE extracted_text END AS extracted,
            CASE WHEN coalesce(predicted_noise_pattern, '') <> '' THEN predicted_noise_pattern
                 WHEN regexp_matches(extracted_text, '"noise_pattern"\\s*:\\s*"([^"]*)"') THEN regexp_extract(extracted_text, '"noise_pattern"\\s*:\\s*"([^"]*)"', 1) END AS predicted_pattern,
            coalesce(1 - label, 1) AS is_noisy, coalesce(noise_category, 'unknown') AS category FROM last),
    r AS (SELECT *, CASE WHEN extracted IS NULL OR {_strip('extracted')} = '' THEN 1 WHEN {_norm('extracted')} = {_norm('translation')} THEN 0 ELSE 1 END AS pred,
            {_norm('extracted')} = {_norm('reference')} AS match, {_cover('extracted', 'translation')} AS cover FROM p)"""
_TP = "sum((pred = 1 AND is_noisy = 1)::INT)::BIGINT AS tp, sum((pred = 1 AND is_noisy = 0)::INT)::BIGINT AS fp, sum((pred = 0 AND is_noisy = 1)::INT)::BIGINT AS fn, count(*)::BIGINT AS total"
_PR = "CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall"


def _metric_sql(keys: str, rows: str) -> str:
    return f"""{_RESULTS}, c AS ({rows}), q AS (SELECT *, total - tp - fp - fn AS tn, {_PR} FROM c)
        SELECT {keys}, tp, fp, fn, tn, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
               CASE WHEN total > 0 THEN (tp + tn)::DOUBLE / total ELSE 0.0 END AS accuracy FROM q"""


_VOTES = f"""WITH last AS (SELECT idx, silver_model, silver_extracted_translation AS v FROM silver_label
        QUALIFY row_number() OVER (PARTITION BY idx, silver_model ORDER BY run_at DESC, loaded_at DESC, silver_extracted_translation DESC NULLS LAST) = 1),
    w AS (SELECT idx, {', '.join(f"max(CASE WHEN silver_model = {_lit(m)} THEN v END) AS v{k}" for k, m in enumerate(VOTERS))} FROM last GROUP BY idx),
    n AS (SELECT *, {', '.join(f"nullif({_norm(f'v{k}')}, '') AS n{k}" for k in range(3))}, {', '.join(f"CASE WHEN {_strip(f'v{k}')} <> '' THEN v{k} END AS p{k}" for k in range(3))} FROM w),
    m AS (SELECT *, CASE WHEN n0 = n1 AND n0 = n2 THEN 3 WHEN n0 = n1 OR n0 = n2 OR n1 = n2 THEN 2 ELSE 1 END AS found,
            CASE WHEN n0 = n1 OR n0 = n2 THEN v0 WHEN n1 = n2 THEN v1 END AS agreed FROM n),
    y AS (SELECT idx, CASE WHEN found > 1 THEN agreed ELSE coalesce(p0, p1, p2) END AS chosen, CASE WHEN found = 1 AND coalesce(p0, p1, p2) IS NULL THEN 0 ELSE found END AS agreement FROM m)"""
_LINES = f"list_filter(string_split(coalesce(translation, ''), chr(10)), lambda x: {_strip('x')} <> '')"
_SPANS = f"""{_B}, l AS (SELECT idx, length(source) AS n_source, translation, {_LINES} AS every, {_LINES}[1:20] AS lines FROM b),
    s AS (SELECT idx, n_source, i, j, {_strip('array_to_string(lines[i:j], chr(10))')} AS span FROM l, generate_series(1, 20) a(i), generate_series(1, 20) z(j) WHERE i <= j AND j <= len(lines) AND len(lines) > 1
          UNION ALL SELECT idx, n_source, 1, 1, {_strip("coalesce(translation, '')")} FROM l WHERE len(lines) <= 1),
    k AS (SELECT * FROM s WHERE span <> '')"""


def _draw(key: str, sides: int) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT % {sides})"


def _weighted(key: str, weights: dict[str, int]) -> str:
    below, parts = 0, []
    for name, w in weights.items():
        below += w
        parts.append(f"WHEN {_draw(key, sum(weights.values()))} < {below} THEN '{name}'")
    return f"CASE {' '.join(parts)} END"


def _choice(key: str, choices: list[str]) -> str:
    return f"CASE {_draw(key, len(choices))} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(choices)) + " END"


def _name(code: str, default: str) -> str:
    return f"(CASE coalesce({code}, '{default}') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in prompts.LANGUAGE_NAMES.items()) + f" ELSE upper(coalesce({code}, '{default}')) END)"


_KEY = "('42|rule|' || idx || '|choice')"
_TO, _FROM, _GAP = _name("tgt_lang", "zh"), _name("src_lang", "en"), "(':' || chr(10) || chr(10))"
_PREAMBLES = [
    f"""'Here is the translation of "' || coalesce(source, '') || '" from ' || {_FROM} || ' to ' || {_TO} || {_GAP} || reference""",
    f"'Here is the ' || {_TO} || ' translation' || {_GAP} || reference",
    f"'Translation from ' || {_FROM} || ' to ' || {_TO} || {_GAP} || reference",
    f"'The ' || {_TO} || ' translation of the above is' || {_GAP} || reference",
]
_RULED = f"""CASE fmt WHEN 'language_prefix' THEN {_TO} || ': ' || reference
    WHEN 'verbose_preamble' THEN {_choice(_KEY, _PREAMBLES)}
    WHEN 'translation_prefix' THEN {_choice(_KEY, [f"'{x} ' || reference" for x in ('Translation:', 'Translated:', 'Translation: ', 'Here is the translation: ')])}
    WHEN 'code_block' THEN '```' || chr(10) || reference || chr(10) || '```'
    WHEN 'special_formatting' THEN {_choice(_KEY, ["'[[' || reference || ']]'", "'{' || reference || '}'"])}
    WHEN 'extra_punctuation' THEN CASE WHEN ends_with(reference, '!') THEN {_choice(_KEY, [f"reference || '{m}'" for m in ('!', '!!', '!!!')])}
        WHEN ends_with(reference, '?') THEN {_choice(_KEY, [f"reference || '{m}'" for m in ('?', '??')])} ELSE {_choice(_KEY, [f"reference || '{m}'" for m in ('!!', '??')])} END END"""


def _pair_name() -> str:
    return f"({_name("split_part(lp, '-', 1)", '')} || '-' || {_name("split_part(lp, '-', 2)", '')})"


def _request(pattern: str) -> str:
    """A provider's request; null for a pattern without one."""
    ask = f"CASE {pattern} " + " ".join(f"WHEN '{k}' THEN {_lit(v)}" for k, v in prompts.NOISE_REQUESTS.items()) + " END"
    return f"({ask} || chr(10) || {_FROM} || ' source: ' || coalesce(source, '') || chr(10) || {_TO} || ' translation: ' || coalesce(reference, ''))"


def _answer(pattern: str) -> str:
    """What the plain stand-in answers."""
    return f"regexp_extract({_request(pattern)}, '(?s)^.*: (.*)$', 1)"


_BUILT = f"""WITH c AS (SELECT DISTINCT * FROM clean_sample WHERE reference IS NOT NULL),
    d AS (SELECT *, row_number() OVER (PARTITION BY lp ORDER BY idx) - 1 AS ordinal, CASE WHEN row_number() OVER (PARTITION BY lp ORDER BY md5('42|' || idx), idx) <= floor(count(*) OVER (PARTITION BY lp) / 2) THEN 'dev' ELSE 'test' END AS split,
        {_weighted("'42|formatting|' || idx", noise.FORMATTING_WEIGHTS)} AS f0, {_weighted("'42|content|' || idx", noise.CONTENT_WEIGHTS)} AS c1, {_weighted("'42|combo-content|' || idx", noise.CONTENT_WEIGHTS)} AS c2, {_weighted("'42|combo|' || idx", noise.COMBO_WEIGHTS)} AS f2 FROM c),
    w AS (SELECT *, 'clean' AS kind, 'none' AS pattern, NULL AS fmt, reference AS said FROM d UNION ALL SELECT *, 'formatting', f0, f0, reference FROM d
        UNION ALL SELECT *, 'content', c1, NULL, {_answer('c1')} FROM d UNION ALL SELECT *, 'combo', c2 || '+' || f2, f2, {_answer('c2')} FROM d),
    built AS (SELECT lp || '_' || format('{{:03d}}', ordinal) || '_' || kind AS id, lp, source, reference, src_lang, tgt_lang, split, CASE WHEN fmt IS NULL THEN said ELSE {_RULED.replace('reference', 'said')} END AS translation,
        (kind = 'clean')::INT AS label, kind AS noise_category, pattern AS noise_pattern FROM w)"""


def _limit(x: str, n: int, mark: str) -> str:
    return f"CASE WHEN length(coalesce({x}, '')) > {n} THEN substr({x}, 1, {n}) || {mark} ELSE coalesce({x}, '') END"


_SILVER_PROMPT = f"""('Languages: ' || coalesce(src_lang, '?') || ' to ' || coalesce(tgt_lang, '?') || chr(10) || 'Noise: ' || CASE WHEN noise_patterns IS NULL OR len(noise_patterns) = 0 THEN 'unknown' ELSE array_to_string(noise_patterns, ', ') END
        || chr(10) || 'Source: ' || {_limit('source', 5000, "' [... truncated ...]'")} || chr(10) || 'Reference: ' || {_limit('reference', 5000, "' [... truncated ...]'")} || chr(10) || 'Output: ' || {_limit('translation', 10000, "chr(10) || '[... truncated ...]'")})"""

SQL: dict[str, str] = {
    "text_normalized": f"{_B} SELECT idx, {_norm('reference')} AS reference, {_norm('translation')} AS translation FROM b",
    "text_labels": f"""{_B} SELECT idx, ({_norm('translation')} = {_norm('reference')})::INT AS synthetic_label, {_norm('translation')} = {_norm('reference')} AS exact_match,
        round({_cover('reference', 'translation')}, 9) AS coverage, ({_cover('reference', 'translation')} > 0.8)::INT AS curated_label, ({_norm('translation')} = {_norm('reference')})::INT AS detection_label FROM b""",
    "text_noise_category": f"{_B} SELECT idx, {_CATEGORY.format('noise_pattern')} AS category, coalesce(1 - label, 1) AS is_noisy FROM b",
    "cleanup_steps": f"""{_B}, s AS (SELECT idx, translation AS t, {_fence('translation')} AS no_fence FROM b),
        c AS (SELECT *, {_brackets('t')} AS no_brackets, {_prefix('t')} AS no_prefix, {_marks('t')} AS no_marks, {_brackets('no_fence')} AS c2 FROM s),
        e AS (SELECT *, {_prefix('c2')} AS c3 FROM c) SELECT idx, no_fence, no_brackets, no_prefix, no_marks, {_strip(_marks('c3'))} AS cleaned FROM e""",
    "explanation_flags": f"{_CLASSIFIED} SELECT out_id, has_explanation FROM k",
    "script_check": f"{_CLASSIFIED} SELECT out_id, {', '.join(f'round({n}, 9) AS {n}' for n in _RANGES)}, language_ok FROM k",
    "rule_instances": f"{_CLASSIFIED} SELECT model, lp, out_id AS \"index\", clean, has_explanation::INT AS has_explanation, wrong_language::INT AS wrong_language, '' AS detected_lang, '0.0000' AS confidence FROM k",
    "rule_report": f"""{_CLASSIFIED}, y AS (SELECT model, lp, {_SUMMARY} FROM k GROUP BY 1, 2 UNION ALL SELECT model, 'OVERALL', {_SUMMARY} FROM k GROUP BY 1) SELECT *, {_RATE_COLUMNS} FROM y""",
    "rule_ranking": f"""{_CLASSIFIED}, y AS (SELECT model, {_SUMMARY} FROM k GROUP BY 1) SELECT row_number() OVER (ORDER BY clean::DOUBLE / total DESC, model)::INT AS place, model, total, clean, clean::DOUBLE / total AS clean_rate FROM y""",
    "rule_zero_filled": f"""{_O}, y AS (SELECT model, lp, count(*) AS total, sum((translation IS NULL)::INT)::BIGINT AS missing FROM o GROUP BY 1, 2)
        SELECT model, lp, coalesce(total, 0) AS total, coalesce(missing, 0) AS missing FROM (SELECT DISTINCT model FROM o) CROSS JOIN (SELECT DISTINCT lp FROM o) LEFT JOIN y USING (model, lp)""",
    "align_results": """WITH b AS (SELECT DISTINCT idx, lp, translation FROM benchmark), last AS (SELECT * FROM llm_result QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC) = 1)
        SELECT result_id, idx, b.lp, method, coalesce(length(b.translation), 0)::INT AS n_translation, coalesce(length(extracted_text), 0)::INT AS n_extracted, coverage FROM b JOIN last USING (idx)""",
    "eval_mode": f"""{_B} SELECT CASE WHEN bool_or(noise_category IN ('formatting', 'content', 'explanation', 'combo', 'clean')) AND bool_or(coalesce(reference, '') <> '' AND reference IS DISTINCT FROM translation) THEN 'synthetic' ELSE 'curated' END AS mode FROM b""",
    "eval_detection": _metric_sql("method", f"SELECT method, {_TP} FROM r GROUP BY 1"),
    "eval_detection_breakdown": _metric_sql("method, category", f"SELECT method, category, {_TP} FROM r GROUP BY 1, 2 UNION ALL SELECT method, 'noisy_only', {_TP} FROM r WHERE category <> 'clean' GROUP BY 1"),
    "eval_extraction": f"""{_RESULTS}, c AS (SELECT method, category, sum(match::INT)::BIGINT AS correct, count(*) AS total FROM r GROUP BY 1, 2 UNION ALL SELECT method, 'all', sum(match::INT)::BIGINT, count(*) FROM r GROUP BY 1
        UNION ALL SELECT method, 'noisy_only', sum(match::INT)::BIGINT, count(*) FROM r WHERE category <> 'clean' GROUP BY 1) SELECT method, category, correct, total, correct::DOUBLE / total AS accuracy FROM c""",
    "eval_coverage": f"{_RESULTS} SELECT method, round(avg(cover), 6) AS avg_coverage FROM r WHERE extracted IS NOT NULL GROUP BY 1",
    "eval_noise_prediction": f"""{_RESULTS}, y AS (SELECT method, sum((is_noisy = 1)::INT)::BIGINT AS total_noisy,
            sum((is_noisy = 1 AND coalesce(predicted_pattern, '') <> '' AND predicted_pattern = coalesce(noise_pattern, ''))::INT)::BIGINT AS pattern_correct,
            sum(coalesce(is_noisy = 1 AND coalesce(predicted_pattern, '') <> '' AND ({_CATEGORY.format('predicted_pattern')}) = coalesce(noise_category, ''), false)::INT)::BIGINT AS category_correct FROM r GROUP BY 1 HAVING count(predicted_pattern) > 0)
        SELECT *, pattern_correct::DOUBLE / total_noisy AS pattern_accuracy, category_correct::DOUBLE / total_noisy AS category_accuracy FROM y WHERE total_noisy > 0""",
    "eval_confusion": f"""{_RESULTS}, y AS (SELECT method, noise_category AS gold, {_CATEGORY.format('predicted_pattern')} AS pred FROM r WHERE is_noisy = 1),
        c AS (SELECT method, gold, pred, count(*) AS n FROM y WHERE gold <> '' AND pred <> '' GROUP BY ALL), l AS (SELECT method, gold AS label FROM c UNION SELECT method, pred FROM c)
        SELECT a.method, a.label AS gold, z.label AS pred, coalesce(n, 0) AS n FROM l a JOIN l z ON a.method = z.method LEFT JOIN c ON c.method = a.method AND c.gold = a.label AND c.pred = z.label""",
    "vote_majority": f"{_VOTES} SELECT idx, chosen, agreement FROM y",
    "vote_silver_reference": f"""{_VOTES} SELECT idx, CASE WHEN found > 1 THEN agreed ELSE p2 END AS silver_reference, found AS silver_agreement, coalesce(v0, '') || '|' || coalesce(v1, '') || '|' || coalesce(v2, '') AS silver_votes, {_lit('|'.join(VOTERS))} AS silver_models FROM m""",
    "vote_agreement": f"""{_VOTES} SELECT d.agreement::INT AS agreement, count(y.idx) AS n, CASE WHEN (SELECT count(*) FROM y) > 0 THEN count(y.idx)::DOUBLE / (SELECT count(*) FROM y) ELSE 0.0 END AS share
        FROM (VALUES (3), (2), (1), (0)) d(agreement) LEFT JOIN y USING (agreement) GROUP BY 1""",
    "vote_inspection": f"{_VOTES} SELECT idx, 'no_extraction' AS sheet, chosen FROM y WHERE chosen IS NULL UNION ALL SELECT idx, 'tie_break', chosen FROM y WHERE agreement = 1 AND chosen IS NOT NULL",
    "silver_success": """WITH last AS (SELECT * FROM silver_label QUALIFY row_number() OVER (PARTITION BY idx, silver_model ORDER BY run_at DESC, loaded_at DESC, silver_extracted_translation DESC NULLS LAST) = 1)
        SELECT silver_model, count(silver_extracted_translation) AS n_ok, count(*) - count(silver_extracted_translation) AS n_failed FROM last GROUP BY 1""",
    "split_stratified": """WITH c AS (SELECT DISTINCT * FROM clean_sample) SELECT idx, lp, CASE WHEN row_number() OVER (PARTITION BY lp ORDER BY md5('42|' || idx), idx) <= floor(count(*) OVER (PARTITION BY lp) / 2) THEN 'dev' ELSE 'test' END AS split FROM c""",
    "split_ids": "WITH c AS (SELECT DISTINCT * FROM clean_sample) SELECT idx, lp || '_' || format('{:03d}', row_number() OVER (PARTITION BY lp ORDER BY idx) - 1) || '_clean' AS id FROM c",
    "split_sample": "WITH c AS (SELECT DISTINCT * FROM clean_sample) SELECT idx, lp FROM c QUALIFY row_number() OVER (PARTITION BY lp ORDER BY md5('42|' || idx), idx) <= 20",
    "split_statistics": "WITH b AS (SELECT DISTINCT * REPLACE (lower(trim(split)) AS split) FROM (SELECT DISTINCT * FROM benchmark)) SELECT split, label, noise_category, count(*) AS n, count(DISTINCT lp) AS n_lp FROM b GROUP BY 1, 2, 3",
    "noise_distribution": f"{_B} SELECT noise_pattern AS value, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM b) AS share FROM b GROUP BY 1",
    "noise_variants": f"""WITH c AS (SELECT DISTINCT * FROM clean_sample), v AS (SELECT *, {_weighted("'42|formatting|' || idx", noise.FORMATTING_WEIGHTS)} AS f0, {_weighted("'42|content|' || idx", noise.CONTENT_WEIGHTS)} AS c1,
            {_weighted("'42|combo-content|' || idx", noise.CONTENT_WEIGHTS)} AS c2, {_weighted("'42|combo|' || idx", noise.COMBO_WEIGHTS)} AS f2 FROM c),
        w AS (SELECT *, 0 AS variant, 'formatting' AS noise_category, f0 AS noise_pattern, f0 AS fmt FROM v UNION ALL SELECT *, 1, 'content', c1, NULL FROM v UNION ALL SELECT *, 2, 'combo', c2 || '+' || f2, NULL FROM v)
        SELECT idx AS clean_idx, variant, noise_category, noise_pattern, {_RULED} AS noisy_translation FROM w""",
    "span_counts": f"{_SPANS} SELECT l.idx, len(l.every)::INT AS n_lines, (SELECT count(*) FROM k WHERE k.idx = l.idx)::INT AS n_spans FROM l",
    "span_best": f"""{_SPANS}, q AS (SELECT *, least(length(span), n_source)::DOUBLE / greatest(length(span), n_source, 1) AS score FROM k)
        SELECT idx, span AS best_span, round(score, 9) AS best_score FROM q QUALIFY row_number() OVER (PARTITION BY idx ORDER BY score DESC NULLS LAST, i, j) = 1""",
    "prompt_silver": f"WITH c AS (SELECT DISTINCT * FROM curated) SELECT idx, {_SILVER_PROMPT} AS prompt FROM c",
    "source_methods": "SELECT DISTINCT 'out/results/' || method || '/' || lp || '/test.jsonl' AS path, method || '/' || lp AS name FROM llm_result",
    "parse_results": rf"""{_RESULTS} SELECT result_id, extracted, CASE WHEN regexp_matches(extracted_text, '"noise_pattern"\s*:\s*"([^"]*)"') THEN regexp_extract(extracted_text, '"noise_pattern"\s*:\s*"([^"]*)"', 1) END AS noise_pattern FROM p""",
    "text_scripts": rf"""{_B}, c AS (SELECT unnest(regexp_split_to_array(translation, '')) AS c FROM b), n AS (SELECT c, count(*) AS n FROM c WHERE c <> '' GROUP BY 1)
        SELECT CASE {' '.join(f"WHEN regexp_matches(c, '^[{r}]$', 's') THEN '{k}'" for k, r in scripts.SCRIPT_RANGES.items())} WHEN regexp_matches(c, '^[\p{{P}}\p{{S}}\p{{N}}]$') THEN 'COMMON' ELSE 'UNKNOWN' END AS script, sum(n)::BIGINT AS n, count(*) AS n_distinct FROM n GROUP BY 1""",
    "source_jsonl": "WITH b AS (SELECT DISTINCT idx, lp, source, translation FROM benchmark) SELECT row_number() OVER (ORDER BY idx) - 1 AS place, * FROM b",
    "source_first_rows": "WITH b AS (SELECT DISTINCT idx, lp, source, translation FROM benchmark) SELECT row_number() OVER (ORDER BY idx) - 1 AS place, idx, lp FROM b QUALIFY place < 100",
    "source_tolerant": "WITH b AS (SELECT DISTINCT idx, translation FROM benchmark WHERE idx % 5 <> 0) SELECT row_number() OVER (ORDER BY idx) - 1 AS place, * FROM b",
    "source_tsv": "SELECT DISTINCT idx, coalesce(source, '') AS source, coalesce(reference, '') AS reference FROM clean_sample",
    "source_discovery": f"""{_O} SELECT DISTINCT model, {_pair_name()} AS lp, 'test_translations.jsonl' AS file, target AS tgt_lang FROM o""",
    "sink_results": """SELECT b.idx, lp, r.translation, noise_pattern, n_results FROM (SELECT DISTINCT idx, lp, translation, noise_pattern FROM benchmark) b
        JOIN (SELECT idx, count(*) AS n_results, max(extracted_text) AS translation FROM llm_result GROUP BY 1) r USING (idx)""",
    "sink_inspection": f"{_VOTES} SELECT idx, CASE WHEN chosen IS NULL THEN 'no_extraction' ELSE 'tie_break' END AS sheet, agreement FROM y WHERE chosen IS NULL OR agreement = 1",
    "sink_report": f"""{_CLASSIFIED}, y AS (SELECT model, lp, {_SUMMARY} FROM k GROUP BY 1, 2 UNION ALL SELECT model, 'OVERALL', {_SUMMARY} FROM k GROUP BY 1), r AS (SELECT *, {_RATE_COLUMNS} FROM y),
        p AS (SELECT *, printf('%.2f%%', clean_rate * 100) AS a, printf('%.2f%%', has_explanation_rate * 100) AS b, printf('%.2f%%', wrong_language_rate * 100) AS c FROM r)
        SELECT model, lp, printf('%-25s %-8d %-8d %-8d %-8d %-9d %-10s %-10s %-10s', lp, total, clean, with_issue, has_explanation, wrong_language, a, b, c) AS line FROM p
        UNION ALL SELECT model, '', printf('%-6d %-50s %-12s %-12s %-12s %d/%d', row_number() OVER (ORDER BY clean_rate DESC, model), model, a, b, c, clean, total) FROM p WHERE lp = 'OVERALL'""",
    "drive_baseline": f"""{_CLASSIFIED}, y AS (SELECT model, {_pair_name()} AS lp, {_SUMMARY} FROM k GROUP BY 1, 2), gr AS (SELECT * FROM (SELECT DISTINCT model FROM k), (SELECT DISTINCT lp FROM y)),
        z AS (SELECT model, lp, coalesce(total, 0) AS total, coalesce(clean, 0) AS clean, coalesce(with_issue, 0) AS with_issue, coalesce(has_explanation, 0) AS has_explanation, coalesce(wrong_language, 0) AS wrong_language FROM gr LEFT JOIN y USING (model, lp)),
        w AS (SELECT * FROM z UNION ALL SELECT model, 'OVERALL', sum(total)::BIGINT, sum(clean)::BIGINT, sum(with_issue)::BIGINT, sum(has_explanation)::BIGINT, sum(wrong_language)::BIGINT FROM z GROUP BY 1)
        SELECT *, {', '.join(f"CASE WHEN total > 0 THEN {c}::DOUBLE / total ELSE 0.0 END AS {c}_rate" for c in ('clean', 'with_issue', 'has_explanation', 'wrong_language'))} FROM w""",
    "drive_noise": f"""WITH c AS (SELECT DISTINCT * FROM clean_sample), v AS (SELECT *, {_weighted("'42|single|' || idx", noise.ALL_WEIGHTS)} AS fmt FROM c)
        SELECT idx, fmt AS noise_pattern, coalesce({_RULED}, {_answer('fmt')}) AS noisy_translation FROM v""",
    "drive_noise_rules": f"""WITH c AS (SELECT DISTINCT * FROM clean_sample), v AS (SELECT {_weighted("'42|single|' || idx", {p: noise.ALL_WEIGHTS[p] for p in noise.ALL_WEIGHTS if p in noise.RULES})} AS value FROM c)
        SELECT value, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM v) AS share FROM v GROUP BY 1""",
    "noise_benchmark": f"{_BUILT} SELECT * FROM built",
    "drive_benchmark": f"{_BUILT} SELECT split, label, noise_category, count(*) AS n, count(DISTINCT lp) AS n_lp FROM built GROUP BY 1, 2, 3",
    "prompt_noise": f"""WITH b AS (SELECT DISTINCT idx, noise_pattern, source, reference, src_lang, tgt_lang FROM benchmark), q AS (SELECT idx, {_request("split_part(noise_pattern, '+', 1)")} AS request FROM b)
        SELECT idx, CASE WHEN request IS NOT NULL THEN 4 END AS n_messages, request FROM q""",
    "model_chat": f"""WITH b AS (SELECT DISTINCT idx, source, translation FROM benchmark),
        q AS (SELECT *, regexp_extract('Give only the clean translation as JSON.' || chr(10) || 'Source: ' || coalesce(source, '') || chr(10) || 'Output: ' || coalesce(translation, ''), '(?s)^.*: (.*)$', 1) AS told FROM b),
        t AS (SELECT idx, length({_strip("coalesce(translation, '')")}) AS n, CASE WHEN {_strip('told')} = '' THEN '{{"extracted_translation": ' || to_json(told)::VARCHAR || ', "noise_pattern": "none"}}' ELSE {_strip('told')} END AS said FROM q)
        SELECT idx, said AS extracted_text, 'none' AS predicted_noise_pattern, round(CASE WHEN n > 0 THEN length(said)::DOUBLE / n ELSE 1.0 END, 6) AS coverage FROM t""",
    "model_spans": f"""{_SPANS}, q AS (SELECT *, least(length(span), coalesce(n_source, 0))::DOUBLE / greatest(length(span), coalesce(n_source, 0), 1) AS score FROM k),
        y AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY idx ORDER BY score DESC, i, j) = 1)
        SELECT l.idx, y.span AS best_span, round(y.score, 9) AS qe_score, ({_cover('y.span', 'l.translation')} >= 0.8)::INT AS label FROM l LEFT JOIN y ON y.idx = l.idx""",
    "span_clean_method": f"""{_SPANS}, q AS (SELECT *, least(length(span), coalesce(n_source, 0))::DOUBLE / greatest(length(span), coalesce(n_source, 0), 1) AS score FROM k),
        y AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY idx ORDER BY score DESC, i, j) = 1),
        f1 AS (SELECT b.idx, b.tgt_lang AS target, b.translation AS original, {_fence('y.span')} AS c1 FROM b LEFT JOIN y ON y.idx = b.idx), f2 AS (SELECT *, {_brackets('c1')} AS c2 FROM f1), f3 AS (SELECT *, {_prefix('c2')} AS c3 FROM f2),
        f4 AS (SELECT *, {_strip(_marks('c3'))} AS translation FROM f3), f5 AS (SELECT *, {_BARE} AS bare FROM f4), f6 AS (SELECT *, length(bare) AS n FROM f5), f7 AS (SELECT *, {_SHARES} FROM f6), f8 AS (SELECT *, {_KEPT} FROM f7)
        SELECT idx, translation AS extracted_text, round({_cover('translation', 'original')}, 6) AS coverage, CASE WHEN coalesce(target, '') = '' THEN false ELSE ({_OK}) END AS language_correct FROM f8""",
    "drive_silver": f"""WITH c AS (SELECT DISTINCT * FROM curated), q AS (SELECT idx, regexp_extract({_SILVER_PROMPT}, '(?s)^.*: (.*)$', 1) AS said FROM c)
        SELECT idx, 'echo' AS silver_model, said AS silver_extracted_translation, replace(replace(json_object('extracted_translation', said, 'noise_pattern', 'none')::VARCHAR, '":"', '": "'), '","noise_pattern"', '", "noise_pattern"') AS silver_raw_response FROM q""",
    "model_retry": f"""WITH c AS (SELECT DISTINCT * FROM curated), q AS (SELECT NOT contains({_SILVER_PROMPT}, '[') AS was_read FROM c) SELECT was_read, count(*) AS n FROM q GROUP BY 1""",
    "model_language": rf"""WITH o AS (SELECT DISTINCT out_id, lower(trim(model)) AS model, translation, reference, split_part(lp, '-', 2) AS target FROM model_output),
        a AS (SELECT *, {_BARE} AS bare FROM o), e AS (SELECT *, length(bare) AS n FROM a), f AS (SELECT *, {_SHARES} FROM e),
        g AS (SELECT *, CASE WHEN coalesce(translation, '') = '' THEN NULL WHEN regexp_matches(translation, '[\x{{4E00}}-\x{{9FFF}}]') THEN 'zh' WHEN regexp_matches(translation, '[\x{{AC00}}-\x{{D7AF}}]') THEN 'ko'
            WHEN regexp_matches(translation, '[\x{{400}}-\x{{4FF}}]') THEN 'ru' WHEN regexp_matches(translation, '[\x{{590}}-\x{{5FF}}]') THEN 'he' WHEN regexp_matches(translation, '[\x{{600}}-\x{{6FF}}]') THEN 'ar' ELSE 'en' END AS detected_lang,
            (CASE WHEN target = 'ru' THEN s_cyrillic * (s_cyrillic >= 0.05)::INT WHEN target = 'ar' THEN s_arabic * (s_arabic >= 0.05)::INT WHEN target = 'zh' THEN s_han * (s_han >= 0.05)::INT
                WHEN target = 'ko' THEN s_hangul * (s_hangul >= 0.05)::INT + s_han * (s_han >= 0.05)::INT ELSE s_latin * (s_latin >= 0.05)::INT END) AS fits FROM f),
        h AS (SELECT *, (CASE WHEN detected_lang IS NULL THEN 0.0 WHEN detected_lang = 'en' THEN 0.4 ELSE 0.9 END)::DOUBLE AS confidence FROM g),
        r AS (SELECT model, detected_lang, confidence, NOT CASE WHEN detected_lang IS NULL THEN false WHEN confidence > 0.5 THEN detected_lang = target
            WHEN target IN ('en','fr','it','de','cs','pl','ru','ar','zh','ko') AND fits >= 0.6 THEN true ELSE detected_lang = target END AS wrong FROM h)
        SELECT model, detected_lang, count(*) AS n, sum(wrong::INT)::BIGINT AS wrong, max(confidence) AS confidence FROM r GROUP BY 1, 2""",
    "eval_curated": f"""{_VOTES}, t AS (SELECT idx, CASE WHEN found > 1 THEN agreed ELSE p2 END AS truth FROM m),
        r AS (SELECT l.silver_model AS method, {_norm('l.v')} = {_norm('t.truth')} AS match FROM last l JOIN t USING (idx)),
        c AS (SELECT method, unnest(['content', 'noisy_only', 'all']) AS category, match FROM r)
        SELECT method, category, sum(match::INT)::BIGINT AS correct, count(*) AS total, sum(match::INT)::DOUBLE / count(*) AS accuracy FROM c GROUP BY 1, 2""",
    "drive_evaluation": f"""WITH b AS (SELECT DISTINCT idx, source, reference, translation, label, noise_category, noise_pattern FROM benchmark),
        l AS (SELECT * FROM llm_result QUALIFY row_number() OVER (PARTITION BY method, idx ORDER BY loaded_at DESC, result_id DESC) = 1),
        j AS (SELECT m.method, b.*, l.extracted_text FROM b CROSS JOIN (SELECT DISTINCT method FROM llm_result) m LEFT JOIN l ON l.method = m.method AND l.idx = b.idx),
        p AS (SELECT *, CASE WHEN regexp_matches(extracted_text, {_lit(_FOLLOWED)}) THEN {_strip(f'regexp_extract(extracted_text, {_lit(_FOLLOWED)}, 1)')} ELSE extracted_text END AS extracted, coalesce(1 - label, 1) AS is_noisy FROM j),
        r AS (SELECT *, CASE WHEN extracted IS NULL OR {_strip('extracted')} = '' THEN 1 WHEN {_norm('extracted')} = {_norm('translation')} THEN 0 ELSE 1 END AS pred, {_norm('extracted')} = {_norm('reference')} AS match FROM p),
        c AS (SELECT method, {_TP}, sum(match::INT)::BIGINT AS correct FROM r GROUP BY 1), q AS (SELECT *, total - tp - fp - fn AS tn, {_PR} FROM c)
        SELECT method, tp, fp, fn, tn, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
            CASE WHEN total > 0 THEN (tp + tn)::DOUBLE / total ELSE 0.0 END AS accuracy, correct, correct::DOUBLE / total AS extraction_accuracy, 'synthetic' AS mode, 2 AS n_left_out FROM q""",
}
_KEY_FIELD = "json_extract_string({0}, '$.extracted_translation')"
_PATTERN_FIELD = "json_extract_string({0}, '$.noise_pattern')"
SQL |= {
    # outputs as Python's and this engine's JSON readers read alike: no value is a list, no key stands twice
    "parse_raw_outputs": rf"""WITH last AS (SELECT result_id, raw_llm_output, translation FROM llm_result QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC) = 1),
        a AS (SELECT *, {_strip('raw_llm_output')} AS r1 FROM last), b AS (SELECT *, CASE WHEN contains(r1, '</think>') THEN {_strip("regexp_replace(r1, '(?s)^.*?</think>', '')")} ELSE r1 END AS r2 FROM a),
        c AS (SELECT *, CASE WHEN regexp_matches(r2, '(?i)^(Thinking Process|思考过程|Thought Process|My Thinking)[:\s]') THEN {_strip("list_filter(regexp_split_to_array(r2, '\\n\\s*\\n'), lambda p: trim(p) <> '')[-1]")} ELSE r2 END AS r3 FROM b),
        e AS (SELECT *, CASE WHEN json_valid(r3) AND starts_with(r3, '{{') AND NOT regexp_matches(r3, ',\s*\}}$') THEN r3 END AS j FROM c),
        f AS (SELECT *, coalesce(nullif({_strip('coalesce(' + _KEY_FIELD.format('j') + ", '')")}, ''), r3) AS x, length({_strip("coalesce(translation, '')")}) AS n FROM e)
        SELECT result_id, x AS extracted_text, {_PATTERN_FIELD.format('j')} AS predicted_noise_pattern, round(CASE WHEN n > 0 THEN length(x)::DOUBLE / n ELSE 1.0 END, 6) AS coverage FROM f""",
    "source_reuse": SQL["split_sample"],
    "sink_instances": SQL["rule_instances"],
    "sink_metrics": SQL["eval_extraction"],
    "sink_confusion": SQL["eval_confusion"].replace("SELECT a.method, a.label AS gold, z.label AS pred, coalesce(n, 0) AS n FROM", ", x AS (SELECT a.method, a.label AS gold, z.label AS pred, coalesce(n, 0) AS n FROM")
    + """) SELECT method, gold, '  ' || rpad(gold, 15, ' ') || string_agg('  ' || lpad(n::VARCHAR, 12, ' '), '' ORDER BY pred) AS line FROM x GROUP BY 1, 2
        UNION ALL SELECT method, '', '  ' || rpad('Gold \\ Pred', 15, ' ') || string_agg('  ' || lpad(pred, 12, ' '), '' ORDER BY pred) FROM (SELECT DISTINCT method, pred FROM x) GROUP BY 1""",
}
