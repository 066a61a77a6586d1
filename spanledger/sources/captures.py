"""Capture records: one JSON file per (release, entry), validated while it is indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.operators.support import computed, settled
from spanledger.sources.text import read_files

FIELDS = ("entry_id rhel_version host redhat_release kernel pkg_versions command_as_run exit_code stdout "
          "stderr captured_on captured_by blast_confirmed undo_executed command_hash_at_capture "
          "verify_result").split()
SCHEMA = ("entry_id string, rhel_version string, host string, redhat_release string, kernel string, "
          "pkg_versions map<string,string>, command_as_run string, exit_code int, stdout string, "
          "stderr string, captured_on string, captured_by string, blast_confirmed string, "
          "undo_executed struct<run:boolean,reason:string>, command_hash_at_capture string, "
          "verify_result string, _bad string")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of every capture file."""
    return read_files(spark, path, "*.json").select(F.col("file").alias("path"), F.col("text").alias("body"))


def judged_captures(files: DataFrame) -> DataFrame:
    """(path, j, codes) of capture files (path, body): the record and what is wrong with it, without state.

    The release directory and the file name must agree with the record, and the command with its digest.
    """
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    d = computed(files, {
        "j": F.from_json("body", SCHEMA, opts),
        "_keys": F.coalesce(F.json_object_keys("body"), F.array().cast("array<string>")),
        "_dir": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1),
        "_name": F.regexp_extract("path", r"([^/]+)\.json$", 1)})
    d = computed(d, {"_agrees": F.sha2("j.command_as_run", 256) == F.col("j.command_hash_at_capture")})
    bad = F.col("j._bad").isNotNull() | F.col("j").isNull()
    absent = F.array_except(F.array(*map(F.lit, FIELDS)), F.col("_keys"))
    whole = ~bad & (F.size(absent) == 0)
    agrees = whole & F.coalesce("_agrees", F.lit(False))
    codes = F.when(bad, F.array(F.lit("not-json"))).otherwise(F.concat(
        F.transform(absent, lambda f: F.concat(F.lit("missing-"), f)),
        F.array_compact(F.array(
            F.when(whole & ~agrees, "hash-mismatch"),
            F.when(agrees & (F.col("j.rhel_version") != F.col("_dir")), "release-differs-from-path"),
            F.when(agrees & (F.col("j.rhel_version") == F.col("_dir"))
                   & (F.col("j.entry_id") != F.col("_name")), "entry-differs-from-name")))))
    return d.select("path", "body", "j", codes.alias("codes"))


def index_captures(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid captures, errors) from ``path`` and ``body``. Errors are rows: path, code.

    A key may come from one file only: the first path keeps it.
    """
    d = judged_captures(files)
    # One narrow row per file is kept, so that the checks below do not parse the files again.
    judged = settled(d.select("path", "j.entry_id", "j.rhel_version", "codes"))
    sound = judged.where(F.size("codes") == 0)
    winners = sound.groupBy("entry_id", "rhel_version").agg(F.min("path").alias("path")).select("path")
    errors = judged.select("path", F.explode("codes").alias("code")).unionByName(
        sound.join(winners, "path", "left_anti").select("path", F.lit("duplicate-key").alias("code")))
    return d.select("path", "j.*").drop("_bad").join(winners, "path", "left_semi"), errors
