"""Command line: ``python -m palimpsest.cli query NAME FOLDER OUT``, ``baseline ROOT``, ``evaluate BENCHMARK RESULT...``, ``noise``, ``build``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .catalogue import QUERIES
from .functions.models import provider_factory
from .plans import baseline, benchmark_build, evaluation
from .sources.readers import first_rows, read_jsonl
from .sources.writers import text_table, write_jsonl


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    query = commands.add_parser("query", help="a query of the catalogue, written as Parquet")
    query.add_argument("query", choices=sorted(QUERIES))
    query.add_argument("folder")
    query.add_argument("out")
    base = commands.add_parser("baseline", help="rule report of a tree of model outputs")
    base.add_argument("root")
    base.add_argument("--models", nargs="+")
    base.add_argument("--pairs", nargs="+")
    base.add_argument("--split", default="test")
    base.add_argument("--out")
    base.add_argument("--instances")
    judge = commands.add_parser("evaluate", help="metrics of result files against a benchmark file")
    judge.add_argument("benchmark")
    judge.add_argument("results", nargs="+")
    judge.add_argument("--mode", choices=("auto", "synthetic", "curated"), default="auto")
    judge.add_argument("--out")
    for name in ("noise", "build"):
        made = commands.add_parser(name, help="one drawn pattern a record" if name == "noise" else "the benchmark with its steps in a folder")
        made.add_argument("clean")
        made.add_argument("out")
        made.add_argument("--seed", type=int, default=42)
        made.add_argument("--n", type=int)
        made.add_argument("--provider", default="plain")
        made.add_argument("--url")
        made.add_argument("--model")
        if name == "noise":
            made.add_argument("--patterns", nargs="+")
            made.add_argument("--rule-based-only", action="store_true")
        else:
            made.add_argument("--skip-sampling", action="store_true")
            made.add_argument("--skip-generation", action="store_true")
    return parser


def main(args: list[str] | None = None) -> None:
    o = _parser().parse_args(args)
    spark = SparkSession.builder.appName(o.command).getOrCreate()
    if o.command == "query":
        QUERIES[o.query](spark, o.folder).write.mode("overwrite").parquet(o.out)
    elif o.command == "baseline":
        print(text_table(baseline.run(spark, o.root, o.out, o.instances, models=o.models, pairs=o.pairs, split=o.split), "report", ["model", "lp"]))
    elif o.command == "evaluate":
        mode, tables, left_out = evaluation.evaluate_files(spark, o.benchmark, o.results, o.mode, o.out)
        print(f"mode: {mode}", *[f"left out: {p}" for p in left_out], *[text_table(df, name, df.columns[:2]) for name, df in tables.items()], sep="\n")
    else:
        clean = first_rows(read_jsonl(spark, o.clean, "lp string, source string, reference string, src_lang string, tgt_lang string", key="idx"), o.n, "idx")
        provider = provider_factory(o.provider, **({"url": o.url, "model": o.model} if o.provider == "http" else {}))
        if o.command == "noise":
            write_jsonl(benchmark_build.single_noise(clean, o.patterns, o.rule_based_only, o.seed, provider), o.out)
        else:
            statistics = benchmark_build.build_to(clean, o.out, seed=o.seed, provider=provider, skip_sampling=o.skip_sampling, skip_generation=o.skip_generation)
            print(text_table(statistics, "statistics", ["split", "label", "noise_category"]))


if __name__ == "__main__":
    main()
