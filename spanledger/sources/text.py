"""Readers of text corpora, JSON lines, markdown tables and nested dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.functions import text as T


def read_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(file, text) of every file below a path; line order inside a file is kept."""
    return (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
            .text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


def read_corpus_lines(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(file, line_no from 1, line) of a directory of text files."""
    return read_files(spark, path, glob).select(
        "file", F.posexplode(T.lines_of(F.col("text"))).alias("_p", "line")).select(
        "file", (F.col("_p") + 1).cast("bigint").alias("line_no"), "line")


def split_manifest(lines: DataFrame, value: str, meta_schema: str, row_schema: str,
                   *keep: str) -> tuple[DataFrame, DataFrame]:
    """(manifest rows, data rows) of JSON lines whose header line holds ``_meta``."""
    parsed = lines.select(*keep, F.from_json(value, f"_meta struct<{meta_schema}>, {row_schema}").alias("j"))
    meta = parsed.where(F.col("j._meta").isNotNull()).select(*keep, "j._meta.*")
    rows = parsed.where(F.col("j._meta").isNull()).select(*keep, "j.*").drop("_meta")
    return meta, rows


def read_jsonl(spark: SparkSession, path: str, meta_schema: str, row_schema: str):
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn(
        "file", F.col("_metadata.file_path"))
    return split_manifest(lines, "value", meta_schema, row_schema, "file")


def markdown_rows(lines: DataFrame, line: str, least: int, header: list[str], *keep: str) -> DataFrame:
    """Cells of markdown table rows; header and rule lines are skipped."""
    s = T.strip(F.col(line))
    cells = F.transform(F.split(F.btrim(s, F.lit("|")), r"\|", -1), T.strip)
    d = lines.where(s.startswith("|") & ~s.startswith("|---")).select(*keep, cells.alias("cells"))
    return d.where((F.size("cells") >= least) & ~F.col("cells")[0].isin(header))


def flatten_map(df: DataFrame, text: Column, value_type: str, *keep: str) -> DataFrame:
    """(name, value) rows of a JSON object held in a string column."""
    return df.select(*keep, F.explode(F.from_json(text, f"map<string,{value_type}>")).alias("name", "value"))


def flatten_dictionary(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(tool, name, takes_arg) rows of a dictionary of tools, their flags and flag names."""
    schema = "map<string,struct<available:boolean,flags:array<struct<names:array<string>,takes_arg:boolean>>>>"
    tools = df.select(*keep, F.explode(F.from_json(text, schema)).alias("tool", "_t"))
    flags = tools.select(*keep, "tool", F.explode("_t.flags").alias("_f"))
    return flags.select(*keep, "tool", F.explode("_f.names").alias("name"), F.col("_f.takes_arg").alias("takes_arg"))
