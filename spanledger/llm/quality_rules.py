"""Quality rules as a short-circuit cascade. DataFrame functions only.

Statistics of each text come first. Further rules are tried in turn and the first that rejects ends the
row; which comes first is decided on a sample, by rejected rows for each second of cost.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.llm.order import free_name
from spanledger.operators.support import Shelf, computed

SPACES = r"\x20\x09-\x0D"
WINDOW = 8
HELPERS = {"_text", "_words", "_lines", "_runs", "_sorted", "_again"}
SAMPLE_ROWS = 1000  # rows, about, on which costs and selectivities are estimated
MOST_TURNS, LONG = 512, 4  # how often the sample is gone over at most, and how long against an idle job is enough


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: str  # SQL over text, the statistics and the other columns


RULES = (
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 3 and 100 * n_dup_lines > 30 * size(split(_text, '\\n'))"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("shouting", "2 * regexp_count(_text, '!!') > n_words"),
    Rule("few_letters", r"2 * length(regexp_replace(_text, '[^\\p{L}]+', '')) < word_chars"),
)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _text and the base statistics; each costly step is a column of its own, made once."""
    d = computed(docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit(""))), {
        "_words": F.regexp_extract_all("_text", F.lit(f"[^{SPACES}]+"), F.lit(0)),
        "_lines": F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(f"[^{SPACES}]")),
        "word_chars": F.length(F.regexp_replace("_text", f"[{SPACES}]+", "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]+", ""))).cast("long")})
    d = computed(d, {
        "n_words": F.size("_words").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_runs": F.expr(f"if(size(_words) < {WINDOW}, cast(array() as array<bigint>), "
                        f"transform(sequence(1, size(_words) - {WINDOW - 1}), i -> xxhash64(slice(_words, i, {WINDOW}))))")}).drop("_words", "_lines")
    # Sorted (hash, place) pairs only of texts that repeat a window at all; equal neighbours are repeats.
    d = computed(d, {"_sorted": F.expr(
        "if(size(array_distinct(_runs)) = size(_runs), cast(array() as array<struct<h:bigint,i:int>>), "
        "sort_array(transform(_runs, (h, i) -> struct(h as h, i as i))))")}).drop("_runs")
    d = computed(d, {"_again": F.expr("sort_array(transform(filter(_sorted, (x, j) -> "
                                      "coalesce(get(_sorted, j - 1).h = x.h, false) or coalesce(get(_sorted, j + 1).h = x.h, false)), x -> x.i))")})
    d = computed(d.drop("_sorted"), {"n_repeat_words": F.expr(
        f"cast(aggregate(transform(_again, (p, j) -> least({WINDOW}, coalesce(get(_again, j + 1), p + {WINDOW}) - p)), 0, (a, x) -> a + x) as bigint)")})
    return d.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))


def measured(sample: DataFrame, rules: tuple[Rule, ...]) -> dict[str, tuple[float, int]]:
    """Seconds and rejected rows of each rule over the (small, stored) sample.

    The sample is gone over again and again inside one job, so often that rules take long against a job that
    judges nothing; the idle job's time is taken off and the rest divided by the turns.
    """
    def seconds(condition: Column, turns: int) -> tuple[float, int]:
        rows = sample.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.lit(turns))))
        begin = time.perf_counter()
        hits = rows.agg(F.count_if(condition)).first()[0]
        return time.perf_counter() - begin, hits // turns
    conditions = {r.name: F.coalesce(F.expr(r.rejects), F.lit(False)) for r in rules}
    every = F.lit(False)
    for c in conditions.values():
        every = every | c
    turns = 8
    seconds(every, 1)
    while turns < MOST_TURNS and seconds(every, turns)[0] < LONG * seconds(F.lit(True), turns)[0]:
        turns *= 4
    idle = min(seconds(F.lit(True), turns)[0] for _ in range(2))
    out = {}
    for name, c in conditions.items():
        took, hits = min(seconds(c, turns) for _ in range(2))
        out[name] = (max(took - idle, 1e-4) / turns, hits)
    return out


def ordered(sample: DataFrame, rules: tuple[Rule, ...]) -> list[Rule]:
    """The rules by rejected rows for each second; among rules that reject as much, none included, the cheaper first."""
    told = measured(sample, rules)
    return sorted(rules, key=lambda r: (-told[r.name][1] / told[r.name][0], told[r.name][0]))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    ``kept`` is false where the base rule or any other rule rejects; the order of the rules decides the
    cost and never the verdict. The sample is drawn evenly from all rows. A null text has no words. Columns of
    the new names are replaced; others may have any names. An empty table gives no rows.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    docs = docs.drop(*new)
    own, names = docs.columns, {c: free_name(docs, f"own{c}") for c in docs.columns if c.lower() in HELPERS}
    docs, text = docs.withColumnsRenamed(names), names.get(text, text)
    told = with_statistics(docs, text)
    some = Shelf(docs.sparkSession).put(
        with_statistics(docs.sample(min(1.0, SAMPLE_ROWS / max(docs.count(), 1)), 1), text).where("not base_failed").select("_text", *new[:5]), "sample")
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for rule in ordered(some, rules):
        verdict = verdict.when(F.coalesce(F.expr(rule.rejects), F.lit(False)), F.lit(False))
    return told.withColumn("kept", verdict.otherwise(F.lit(True))).select(*[F.col(names.get(c, c)).alias(c) for c in own], *new)
