"""Word n-gram overlap of texts with protected sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.functions import text as T


def ngram_overlap(texts: DataFrame, key: str, text: str, protected: DataFrame,
                  protected_text: str, n: int = 8) -> DataFrame:
    """Texts that share an n-word run with any protected text.

    Gives (key, distinct shared grams, first of them in order). Grams travel as 64-bit numbers, each once a
    text: those that the protected texts have as well (a semi join, so no pairs of texts are emitted) come back as
    a short list to their text, whose grams with such a number are compared as text with the protected ones.
    So a gram crosses the network as text only where its number is shared.
    """
    every = protected.select(F.explode(F.array_distinct(T.ngrams(F.col(protected_text), n))).alias("gram")).distinct()
    number = lambda grams: F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g)))
    own = texts.select(key, F.explode(number(T.ngrams(F.col(text), n))).alias("h"))
    shared = own.join(every.select(F.xxhash64("gram").alias("h")).distinct(), "h", "left_semi")
    met = shared.groupBy(key).agg(F.collect_set("h").alias("_met"))
    back = texts.select(key, text).join(met, key)
    grams = F.filter(F.array_distinct(T.ngrams(F.col(text), n)), lambda g: F.array_contains("_met", F.xxhash64(g)))
    per_gram = back.select(key, F.explode(grams).alias("gram")).join(every, "gram", "left_semi").distinct()
    return per_gram.groupBy(key).agg(F.count("*").alias("shared_grams"), F.min("gram").alias("first_gram"))


def governed_texts(rows: DataFrame, license_class: str = "paraphrase-only") -> DataFrame:
    """Fields whose own licence, or else their row's, is the given class."""
    return rows.where(F.coalesce("field_license", "row_license") == license_class)


def in_several_families(lines: DataFrame, text: str, family: str) -> DataFrame:
    """Texts found in more than one family, filed under the governing family."""
    per = lines.groupBy(text).agg(
        F.count_distinct(family).alias("n_families"), F.count("*").alias("n_lines"),
        F.min(F.struct(F.when(F.col("authority") == "governing", 0).otherwise(1).alias("r"),
                       F.col(family).alias("f"))).alias("_top"))
    return per.where(F.col("n_families") > 1).select(
        text, "n_families", "n_lines", F.col("_top.f").alias("filed_under"))
