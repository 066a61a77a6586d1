"""URL verdicts: host and path rules, else gradient-boosted trees on lexical features.

DataFrame functions and Spark's own tree learner only. The trees are fitted on a bounded number of
labelled URLs; every URL is judged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.operators.support import computed

TRAINING_ROWS = 20_000  # at most so many labelled URLs are fitted, those with the least hashes
PARTS = ["length", "host_length", "path_length", "depth", "labels", "digits", "hyphens", "entropy", "parameters", "upper", "suffix_rate"]
#: Words of hosts that stand for bad ones where no labels are given.
BAD_HOST_WORDS = ("casino", "pills", "spam", "ads")


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (HostRule("allow", "com", "/"), HostRule("block", "example.com", "/en/"), HostRule("allow", "www.example.com", "/en/"),
         HostRule("block", "net", "/es/"), HostRule("block", "net", "/fr/"))


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; both are empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def longest_rule(rules: tuple[HostRule, ...], host: str = "host", path: str = "path") -> Column:
    """(rule, verdict) of the longest rule whose host is this one or a parent of it and whose path begins the path."""
    best = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((F.col(host) == r.host) | F.col(host).endswith("." + r.host)) & F.col(path).startswith(r.path)
        told = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        best = F.when(fits, told) if best is None else best.when(fits, told)
    return best if best is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def with_host(df: DataFrame) -> DataFrame:
    host, path = host_and_path("url")
    return computed(df, {"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` (with host and path) and the lexical features of each URL."""
    u = F.coalesce(F.col(url), F.lit(""))
    removed = lambda c, pattern: (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))).cast("double")
    entropy = F.expr("aggregate(transform(array_distinct(split(host, '')), c -> (length(host) - length(replace(host, c, ''))) / length(host)), "
                     "cast(0 as double), (a, p) -> a - if(p > 0, p * ln(p), 0))")
    return df.select("*", F.length(u).cast("double").alias("length"), F.length("host").cast("double").alias("host_length"),
                     F.length("path").cast("double").alias("path_length"), removed(F.col("path"), "/").alias("depth"),
                     removed(F.col("host"), r"\.").alias("labels"), (removed(u, "[0-9]") / F.greatest(F.length(u), F.lit(1))).alias("digits"),
                     removed(F.col("host"), "-").alias("hyphens"), F.when(F.col("host") == "", 0.0).otherwise(entropy).alias("entropy"),
                     removed(u, "[?&]").alias("parameters"), removed(u, "[A-Z]").alias("upper"),
                     F.xxhash64(F.regexp_extract("host", r"([^.]*)\z", 1)).alias("suffix"))


def _with_suffix_rate(df: DataFrame, rates: DataFrame) -> DataFrame:
    """Rates are two numbers for each suffix and no more rows than were fitted, so they go to every task."""
    return df.join(F.broadcast(rates), "suffix", "left").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(0.0)))


def fitted(labelled: DataFrame, rows: int = TRAINING_ROWS) -> tuple[GBTClassificationModel | None, DataFrame]:
    """The trees, and the table of suffix rates (at most as many rows as were fitted).

    ``labelled`` is (url, label). With one class only there is nothing to learn and no model.
    """
    spark = labelled.sparkSession
    some = labelled.where("url is not null and label is not null").orderBy(F.xxhash64("url"), "url", "label").limit(rows)
    some = lexical(with_host(some))
    rates = some.groupBy("suffix").agg(((F.sum("label") + 1.0) / (F.count("*") + 2.0)).alias("suffix_rate"))
    rates = spark.createDataFrame(rates.collect(), rates.schema)
    assembled = VectorAssembler(inputCols=PARTS, outputCol="features").transform(
        _with_suffix_rate(some, rates)).select("features", F.col("label").cast("double").alias("label")).repartition(4).cache()
    try:
        if assembled.select("label").distinct().count() < 2:
            return None, rates
        return GBTClassifier(maxIter=12, maxDepth=4, maxBins=64, seed=1).fit(assembled), rates
    finally:
        assembled.unpersist()


def judged(pages: DataFrame, labelled: DataFrame, rules: tuple[HostRule, ...] = RULES, key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, score): the longest rule's verdict, else that of the trees.

    A null URL, or one without ``://``, has empty host and path, fits no rule and is judged by its other
    features. Without two classes of labels the trees allow. Other columns are ignored.
    """
    rows = with_host(pages.select(key, "url"))
    rows = lexical(rows.withColumn("told", longest_rule(rules)))
    model, rates = fitted(labelled)
    if model is None:
        scored = rows.withColumn("score", F.lit(0.0))
    else:
        scored = model.transform(VectorAssembler(inputCols=PARTS, outputCol="features").transform(_with_suffix_rate(rows, rates)))
        from pyspark.ml.functions import vector_to_array
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    return scored.select(key, "host", "path", F.col("told.rule").alias("rule"), F.coalesce(
        "told.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def labelled_by_host(pages: DataFrame, words: tuple[str, ...] = BAD_HOST_WORDS) -> DataFrame:
    """(url, label): 1 where a part of the host between dots and hyphens is one of the words."""
    host, _ = host_and_path("url")
    parts = F.split(F.coalesce(host, F.lit("")), r"[.\-]")
    return pages.where("url is not null").select("url", F.arrays_overlap(parts, F.array(*map(F.lit, words))).cast("int").alias("label"))
