"""Rule rows from XML and the identity of the release that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.functions import text as T
from spanledger.operators.support import settled

GROUP = ("_id string, Rule struct<_id:string,_severity:string,version:string,title:string,"
         "ident:array<struct<_system:string,_VALUE:string>>,"
         "check:struct<`check-content`:string>,fixtext:string>")
# Fixed values. Severity to category.
CATEGORY = {"high": "I", "medium": "II", "low": "III"}


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Group elements of rule files, one row each, with their file."""
    return (spark.read.format("xml").option("rowTag", "Group").schema(GROUP).load(path)
            .select(F.col("_metadata.file_path").alias("file"), "*"))


def parse_groups(df: DataFrame, xml: str, *keep: str) -> DataFrame:
    """The same rows from a string column that holds one Group element."""
    return df.select(*keep, F.from_xml(F.col(xml), GROUP).alias("g")).select(*keep, "g.*")


def rule_rows(groups: DataFrame, *keep: str) -> DataFrame:
    """Flat rules: group, rule and stig ids, category, title, ordered idents, check and fix."""
    cats = F.create_map(*[x for kv in CATEGORY.items() for x in map(F.lit, kv)])
    idents = F.filter(F.coalesce("Rule.ident", F.array()), lambda i: F.lower(i["_system"]).contains("cci"))
    return groups.select(
        *keep, F.col("_id").alias("v"), F.trim("Rule.version").alias("i"), F.col("Rule._id").alias("rid"),
        F.try_element_at(cats, F.col("Rule._severity")).alias("c"),
        T.clean_markup(F.col("Rule.title")).alias("t"),
        F.array_distinct(F.transform(idents, lambda i: F.trim(i["_VALUE"]))).alias("cci"),
        T.clean_markup(F.col("Rule.check.check-content")).alias("chk"),
        T.clean_markup(F.col("Rule.fixtext")).alias("fix"))


def rule_violations(rules: DataFrame) -> DataFrame:
    """(v, code) for a missing id, an unknown severity, or an id used twice. Rules are read once."""
    rules = settled(rules.select("v", "i", "c"))
    dup = rules.groupBy("i").agg(F.count("*").alias("n"), F.min("v").alias("v")).where(
        (F.col("n") > 1) & (F.col("i") != "")).select("v", F.lit("duplicate-id").alias("code"))
    codes = F.array_compact(F.array(
        F.when(F.coalesce("i", F.lit("")) == "", "missing-id"),
        F.when(F.col("c").isNull(), "unknown-severity")))
    return rules.select("v", F.explode(codes).alias("code")).unionByName(dup)


def release_tag(version: Column, info: Column) -> Column:
    """VnRm from a version number and a 'Release: m' header, '' if either is missing."""
    release = F.regexp_extract(info, r"Release:\s*([0-9.]+)", 1)
    return F.when((version != "") & (release != ""), F.concat(F.lit("V"), version, F.lit("R"), release)).otherwise("")


def release_identity(files: DataFrame, declared: Column, named: Column) -> DataFrame:
    """Adds ``identity`` and ``status``: match, mismatch, undeclared or unnamed."""
    return files.withColumns({
        "identity": F.when(declared != "", declared).otherwise(named),
        "status": F.when(declared == "", "undeclared").when(named == "", "unnamed")
        .when(declared != named, "mismatch").otherwise("match")})


def crosswalk(items: DataFrame, referenced: DataFrame, excluded: str = "800-53A") -> DataFrame:
    """Per referenced code the reference of the highest revision, the first one on a tie.

    items: cci, title, rev, pos, index. Unreferenced codes are removed by a semi join first.
    """
    kept = items.where(~F.col("title").contains(excluded)).join(referenced, "cci", "left_semi")
    top = F.max(F.struct("rev", (-F.col("pos")).alias("p"), "index")).alias("_t")
    return kept.groupBy("cci").agg(top).select("cci", F.col("_t.rev").alias("rev"), F.col("_t.index").alias("nist"))
