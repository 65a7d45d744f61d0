"""Writers: JSON lines with nulls, result tables, instance TSV, inspection sheets, nested metrics, text reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.align import merge_results


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, UTF-8, null fields written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_results(items: DataFrame, results: DataFrame, path: str, key: str = "idx") -> None:
    """Input rows with result fields, the result winning on a clash."""
    write_jsonl(merge_results(items, results, key), path)


def instance_table(classified: DataFrame) -> DataFrame:
    """``model, lp, index, clean, has_explanation, wrong_language, detected_lang, confidence`` as strings and 0/1."""
    return classified.select(
        "model", "lp", "index", F.col("label").alias("clean"), F.col("has_explanation").cast("int").alias("has_explanation"), F.col("wrong_language").cast("int").alias("wrong_language"),
        F.coalesce("detected_lang", F.lit("")).alias("detected_lang"), F.format_string("%.4f", F.col("confidence")).alias("confidence"),
    )


def write_instances(classified: DataFrame, path: str) -> None:
    """The instance table as TSV, one folder a model and pair."""
    instance_table(classified).write.mode("overwrite").partitionBy("model", "lp").csv(path, sep="\t", header=True, emptyValue="")


def write_inspection(sheets: dict[str, DataFrame], path: str) -> list[str]:
    """Each sheet that has rows as CSV under its name; array columns are joined. Gives the names written."""
    written = []
    for name, df in sheets.items():
        if df.isEmpty():
            continue
        flat = df.withColumns({c: F.array_join(c, ", ") for c, t in df.dtypes if t == "array<string>"})
        flat.write.mode("overwrite").csv(f"{path}/{name}", header=True, escape="\"")
        written.append(name)
    return written


def nested_metrics(long: DataFrame, method: str = "method", category: str = "category") -> dict:
    """Small long metrics (a row a method and category) as a nested dict."""
    out: dict = {}
    for row in long.collect():
        fields = row.asDict()
        out.setdefault(fields.pop(method), {})[fields.pop(category)] = fields
    return out


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, on any file system Spark knows."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = location.getFileSystem(spark._jsc.hadoopConfiguration()).create(location, True)
    try:
        stream.write(bytearray(text.encode("utf-8", "surrogatepass")))
    finally:
        stream.close()


def write_metrics(long: DataFrame, path: str, method: str = "method", category: str = "category") -> None:
    write_text(long.sparkSession, path, json.dumps(nested_metrics(long, method, category), ensure_ascii=False, indent=2, sort_keys=True))


def text_table(df: DataFrame, title: str, order: list[str]) -> str:
    """A small aggregate as an aligned text table."""
    rows = [[("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in df.orderBy(*order).collect()]
    widths = [max(len(x) for x in col) for col in zip(df.columns, *rows, strict=True)]
    line = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip()
    return "\n".join([title, line(df.columns), line(["-" * w for w in widths]), *map(line, rows)])


_RULE = "=" * 140
_ISSUES = ("total", "clean", "with_issue", "has_explanation", "wrong_language")


def _percent(rate: Column) -> Column:
    return F.format_string("%.2f%%", F.col(rate) * 100)


def baseline_lines(report: DataFrame) -> DataFrame:
    """``(model, lp, line)``: the table line of each row of the baseline's report."""
    numbers = [F.format_string("%-9d" if c == "wrong_language" else "%-8d", c) for c in _ISSUES]
    shares = [F.rpad(_percent(c), 10, " ") for c in ("clean_rate", "has_explanation_rate", "wrong_language_rate")]
    return report.select("model", "lp", F.concat_ws(" ", F.format_string("%-25s", "lp"), *numbers, *shares).alias("line"))


def ranking_lines(report: DataFrame) -> DataFrame:
    """``(place, model, line)``: models by falling clean rate, then name. There are as many rows as models."""
    placed = report.where("lp = 'OVERALL'").withColumn("place", F.row_number().over(Window.orderBy(F.desc("clean_rate"), "model")))
    shares = [F.rpad(_percent(c), 12, " ") for c in ("clean_rate", "has_explanation_rate", "wrong_language_rate")]
    line = F.concat_ws(" ", F.format_string("%-6d", "place"), F.format_string("%-50s", "model"), *shares, F.format_string("%d/%d", "clean", "total"))
    return placed.select("place", "model", line.alias("line"))


def baseline_text(report: DataFrame) -> str:
    """The baseline's report: a section a model, and the comparison if there are several. It has a line a model and pair."""
    sections: dict[str, list[str]] = {}
    overall = {}
    for row in baseline_lines(report).orderBy("model", "lp").collect():
        if row.lp == "OVERALL":
            overall[row.model] = row.line
        else:
            sections.setdefault(row.model, []).append(row.line)
    head = f"{'Language Pair':<25} {'Total':<8} {'Clean':<8} {'Issues':<8} {'w/Expl':<8} {'WrongLng':<9} {'Clean%':<10} {'Expl%':<10} {'WrongL%':<10}"
    out = [_RULE, "Instruction following: explanations and wrong language", _RULE]
    for model in sorted(overall):
        out += ["", _RULE, f"Model: {model}", _RULE, "", head, "-" * 140, *sections.get(model, []), "-" * 140, overall[model]]
    if len(overall) > 1:
        title = f"{'Rank':<6} {'Model':<50} {'Clean%':<12} {'Expl%':<12} {'WrongL%':<12} {'Clean/Total':<15}"
        out += ["", "", _RULE, "Comparison of models", _RULE, "", title, "-" * 140, *[r.line for r in ranking_lines(report).orderBy("place").collect()]]
    return "\n".join([*out, "", _RULE])


def confusion_lines(confusion: DataFrame) -> DataFrame:
    """``(method, gold, line)``: a line of counts for each gold category of a square confusion table (predictions in the order of
    their names); the line of gold '' is the head."""
    cells = confusion.groupBy("method", "gold").agg(F.array_sort(F.collect_list(F.struct("pred", "n"))).alias("c"))
    row = lambda name, cell: F.concat(F.lit("  "), F.rpad(name, 15, " "), F.array_join(F.transform("c", lambda x: F.concat(F.lit("  "), F.lpad(cell(x), 12, " "))), ""))
    body = cells.select("method", "gold", row(F.col("gold"), lambda x: x["n"].cast("string")).alias("line"))
    first = cells.groupBy("method").agg(F.min_by("c", "gold").alias("c"))
    return body.unionByName(first.select("method", F.lit("").alias("gold"), row(F.lit("Gold \\ Pred"), lambda x: x["pred"]).alias("line")))
