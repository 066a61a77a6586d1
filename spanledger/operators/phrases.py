"""Substring join of lines with a table of phrases of any size.

Every phrase is keyed by its rarest inner word, one that stands between two blanks of the phrase: a line can hold
the phrase only if it holds that word between blanks. A phrase without one is keyed by its rarest q-gram (q letters
running), or by itself if it is shorter. Lines meet phrases on the key and ``contains`` decides, so no line is crossed
with all phrases and no list of phrases stands in code. Grams are cut only where some phrase needs them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.operators.support import Shelf

Q = 6


def folded(text: Column) -> Column:
    """Lower case, and the same without quotes behind a line feed: a phrase may stand in either."""
    low = F.lower(text)
    bare = F.translate(low, "\"'", "")
    return F.when(low == bare, low).otherwise(F.concat(low, F.lit("\n"), bare))


def _grams(text: Column, q: Column | int) -> Column:
    """The distinct runs of q letters of a text, as 64-bit numbers."""
    q = F.lit(q) if isinstance(q, int) else q
    return F.when(F.length(text) >= q, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.xxhash64(F.substring(text, i, q))))).otherwise(
        F.expr("cast(array() as array<bigint>)"))


def _inner(text: Column) -> Column:
    """The distinct words between two blanks of a text."""
    words = F.split(text, " ", -1)
    return F.array_distinct(F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != ""))


def phrase_hits(lines: DataFrame, key: list[str], text: str, phrases: DataFrame, phrase_key: str = "phrase_id",
                phrase: str = "phrase", q: int = Q) -> DataFrame:
    """(key, phrase_key) of each line that holds a phrase, whatever the case, with or without its quotes.

    ``key`` is unique. Phrases that are null or empty hold nowhere. Rareness is counted over all lines; only
    the words and grams that some phrase has leave their line.
    """
    shelf = Shelf(lines.sparkSession)
    told = shelf.put(phrases.select(phrase_key, F.lower(phrase).alias("_phrase")).where("_phrase <> ''").withColumn(
        "_words", _inner(F.col("_phrase"))).withColumn(
        "_q", F.when(F.size("_words") == 0, F.least(F.length("_phrase"), F.lit(q)))), "phrases")
    sizes = sorted(r["_q"] or 0 for r in told.select("_q").distinct().collect())  # at most q, 0 for words
    if not sizes:
        return lines.select(*key, F.lit(None).cast(dict(phrases.dtypes)[phrase_key]).alias(phrase_key)).where("false")
    own = lines.select(*key, folded(F.col(text)).alias("_line"))
    cut, kinds = told.where("_q is null").select(phrase_key, "_phrase", F.explode("_words").alias("_g")), []
    if sizes[0] == 0:
        words = own.select(*key, F.explode(_inner(F.col("_line"))).alias("_g"))
        kinds.append(words.join(cut.select("_g").distinct(), "_g", "left_semi"))
    if sizes[-1] > 0:
        gram = F.concat(F.lit(" "), F.col("_g").cast("string"))  # a blank tells it from a word
        keyed = told.where("_q is not null").select(phrase_key, "_phrase", F.explode(_grams(F.col("_phrase"), F.col("_q"))).alias("_g")).withColumn("_g", gram)
        grams = own.select(*key, F.explode(F.concat(*[_grams(F.col("_line"), n) for n in sizes if n])).alias("_g")).withColumn("_g", gram)
        kinds.append(grams.join(keyed.select("_g").distinct(), "_g", "left_semi"))
        cut = cut.unionByName(keyed)
    met = shelf.put(reduce(DataFrame.unionByName, kinds), "met")
    often = met.groupBy("_g").agg(F.count("*").alias("_n"))
    # A phrase with a key that no line has is in no line.
    # Stored, so that the planner sees which side is small.
    rarest = shelf.put(cut.join(often, "_g", "left").groupBy(phrase_key, "_phrase").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_g").alias("g"))).alias("_r")).where("_r.n > 0").select(
        phrase_key, "_phrase", F.col("_r.g").alias("_g")), "rarest")
    candidates = met.join(rarest, "_g").select(*key, phrase_key, "_phrase")
    return own.join(candidates, key).where(F.contains("_line", "_phrase")).select(*key, phrase_key)
