"""Readers: JSON lines (strict and tolerant, with the place of a line as key), TSV with escaped line breaks, discovery of model outputs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import strip
from ..session import barrier

# Parts of the names of thinking models, and the pairs of a report.
THINKING = ("thinking", "reasoning", "r1-distill")
PAIRS = (
    "Russian-French", "Arabic-Chinese", "Chinese-French", "Chinese-Russian", "Arabic-Hebrew", "Korean-French", "French-Italian", "German-French",
    "German-Italian", "English-Chinese", "English-Russian", "English-Tamil", "English-German", "English-Czech", "English-Polish", "Chinese-English",
    "Russian-English", "Tamil-English", "German-English", "Czech-English", "Khmer-English", "Korean-Chinese",
)
# Language names in directory names such as ``English-German``.
NAME_CODES = {
    "English": "en", "Chinese": "zh", "French": "fr", "German": "de", "Arabic": "ar", "Russian": "ru", "Hebrew": "he", "Czech": "cs",
    "Polish": "pl", "Tamil": "ta", "Khmer": "km", "Korean": "ko", "Italian": "it", "Spanish": "es", "Japanese": "ja",
    "Portuguese": "pt", "Turkish": "tr",
}


def numbered(rows: DataFrame, key: str, per: list[str] | None = None) -> DataFrame:
    """``rows`` with ``key``: the 0-based place of each among the rows of its ``per`` columns, in the order of path, block and
    place in the block. ``rows`` comes from a file scan with ``_path``, ``_block`` and ``_mark`` (see :func:`lines`), which are dropped.

    The blocks' counts (a row a block) carry the places across, so no task sees a whole file."""
    per = per or []
    blocks = rows.groupBy(*per, "_path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mark").alias("_least"))
    before = Window.partitionBy(*per).orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_path", "_block", "_least", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = rows.join(blocks, ["_path", "_block"])
    kept = [c for c in rows.columns if c not in ("_path", "_block", "_mark", key)]
    return placed.select((F.col("_before") + F.col("_mark") - F.col("_least")).alias(key), *kept)


def _marked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_mark", F.monotonically_increasing_id())


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(value, _path, _block)`` of the lines that are not blank."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
    return read.where(strip(F.col("value")) != "")


def parsed_lines(spark: SparkSession, path: str | list[str], schema: StructType | str | None, tolerant: bool, keep_line: bool = False) -> DataFrame:
    """The objects of the lines with the columns that :func:`numbered` needs. A bad line is an error, or left out if ``tolerant``
    (it is then not counted)."""
    if schema is None:
        schema = spark.read.option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path).schema
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    bad = "_corrupt_record"
    read = F.from_json("value", StructType([*schema.fields, StructField(bad, StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    rows = barrier(lines(spark, path), _object=read)
    broken = F.col("_object").isNull() | F.col(f"_object.{bad}").isNotNull()
    rows = rows.where(~broken) if tolerant else rows.where(F.when(broken, F.raise_error(F.concat(F.lit("no JSON object: "), F.substring("value", 1, 200)))).otherwise(F.lit(True)).cast("boolean"))
    return _marked(rows).select(*[F.col(f"_object.`{f.name}`").alias(f.name) for f in schema.fields], *(["value"] if keep_line else []), "_path", "_block", "_mark")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, tolerant: bool = False, key: str | None = None) -> DataFrame:
    """Objects one a line; blank lines are skipped. A bad line is an error, or dropped and not counted if ``tolerant``.

    ``key`` names a column for the place of each object in the file (from 0), by which files are aligned; a field of the same name
    is replaced."""
    rows = parsed_lines(spark, path, schema, tolerant)
    return numbered(rows, key) if key else rows.drop("_path", "_block", "_mark")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A TSV with header, all strings; the two characters ``\\n`` in ``source`` and ``reference`` become a line break."""
    df = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True)
    texts = [c for c in ("source", "reference") if c in df.columns]
    return df.withColumns({c: F.replace(F.col(c), F.lit("\\n"), F.lit("\n")) for c in texts})


def read_input(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """TSV by its suffix (lower case), else JSON lines."""
    return read_tsv(spark, path) if path.endswith(".tsv") else read_jsonl(spark, path, schema)


def first_rows(df: DataFrame, n: int | None, key: str) -> DataFrame:
    """The first ``n`` rows by the place in ``key`` (see :func:`read_jsonl`); none or 0 means all."""
    return df.where(F.col(key) < n) if n else df


def _listing(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(location):
        return []
    return sorted((s.getPath().getName(), s.isDirectory()) for s in system.listStatus(location))


def exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def reuse_or(spark: SparkSession, path: str, make, skip: bool = False) -> DataFrame:
    """The table at ``path`` if ``skip`` and it is there, else what ``make`` gives, written there first."""
    if not (skip and exists(spark, path)):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def discover_models(spark: SparkSession, root: str, wanted: list[str] | None = None) -> list[str]:
    """Sorted names of the model folders, or those of ``wanted`` that exist."""
    found = [name for name, folder in _listing(spark, root) if folder]
    return [m for m in wanted if m in found] if wanted else found


def candidate_files(lp: str, split: str, model: str) -> list[str]:
    """Names a translation file may have, best first: thinking models have only the regular one, others may have an original."""
    regular, original = f"{lp}/{split}_translations.jsonl", f"{lp}/{split}_translations_original.jsonl"
    return [regular] if any(t in model.lower() for t in THINKING) else [original, regular]


def translation_files(spark: SparkSession, root: str, models: list[str], pairs: list[str], split: str) -> list[tuple[str, str, str]]:
    """``(model, pair, path)`` of the file that counts for each model and pair that has one."""
    found = ((m, lp, find_translation_file(spark, root, lp, split, m)) for m in models for lp in pairs)
    return [(m, lp, path) for m, lp, path in found if path is not None]


def find_translation_file(spark: SparkSession, root: str, lp: str, split: str, model: str) -> str | None:
    return next((p for name in candidate_files(lp, split, model) if exists(spark, p := f"{root}/{model}/{name}")), None)


def target_language_of_path(path: str, strict_compat: bool = False) -> str:
    """Target language of a path with a part ``Name-Name``. ``strict_compat``: the first part that holds a hyphen and one of
    the lower-case codes decides, and only a known name after its hyphen counts."""
    for part in path.split("/"):
        if strict_compat:
            if "-" in part and any(code in part for code in NAME_CODES.values()):
                return NAME_CODES.get(part.split("-")[1], "")
        elif m := re.fullmatch(r"([A-Z][a-z]+)-([A-Z][a-z]+)", part):
            if m[1] in NAME_CODES and m[2] in NAME_CODES:
                return NAME_CODES[m[2]]
    return ""


def method_name(path: Column) -> Column:
    """Method of a result path: the folders between ``results`` and the file, else the file's stem."""
    inner = F.regexp_extract(path, r"(?:^|/)results/(.+)/[^/]+$", 1)
    return F.when(inner != "", inner).otherwise(F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", ""))
