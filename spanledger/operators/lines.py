"""From texts to anchored lines, prompts and prompt-marked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.functions import text as T
from spanledger.functions import words as W
from spanledger.operators.support import computed


def explode_lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per line: the kept columns, ``line_no`` from 1, and ``line``."""
    return df.select(*keep, F.posexplode(T.lines_of(F.col(text))).alias("_pos", "line")).select(
        *keep, (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line")


def anchored_lines(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Lines of several text fields of a row, anchored by (key, field, line number).

    Blank lines are dropped; shebang and banner lines are routed to ``config-fragment``.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("body")) for f in fields])
    per_field = df.select(F.col(key).alias("row_key"), F.explode(pairs).alias("p"))
    lines = explode_lines(per_field.select("row_key", "p.field", "p.body"),
                          "body", "row_key", "field")
    stripped = T.strip(F.col("line"))
    return (lines.withColumn("text", stripped).where(F.col("text") != "").drop("line")
            .withColumn("route", F.when(F.col("text").rlike("^#[!#]"), "config-fragment")
                        .otherwise("line")))


def with_prompt(df: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``prompt`` ('$', '#' or '') and ``command``, the text behind the prompt."""
    s = T.strip(F.col(line))
    d = computed(df, {"_s": s, "_loose": F.regexp_extract(s, T.PROMPT, 1), "_tight": s.rlike(T.TIGHT_PROMPT)})
    loose, body = F.col("_loose") != "", F.col("_s")
    return computed(d, {
        "prompt": F.when(loose, F.col("_loose")).when(F.col("_tight"), "#").otherwise(""),
        "command": F.when(loose | F.col("_tight"), T.strip(body.substr(F.lit(2), F.length(body)))).otherwise(""),
    }).drop("_s", "_loose", "_tight")


def head_refusal(first: Column) -> Column:
    """The refusal class of a line's first token, or 'accepted'."""
    head = F.lower(T.basename(first))
    return (F.when(first.rlike(T.ENV_ASSIGN), "assignment")
            .when(head.isin(W.SHELL_KEYWORD_HEADS), "shell-keyword")
            .when(head.isin(W.FUNCTION_WORD_HEADS), "function-word")
            .when(T.basename(first).isin(W.REFUSED_HEADS), "wrapper-shell")
            .otherwise("accepted"))


def invisible_hits(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code point, count, first line) of every invisible character.

    A byte order mark is allowed as the very first character only. Rows without a hit
    are dropped by one regular expression before anything is exploded.
    """
    body = F.regexp_replace(F.col(text), r"\A\x{FEFF}", "")
    dirty = df.select(key, body.alias("_body")).where(T.has_invisible(F.col("_body")))
    lines = explode_lines(dirty, "_body", key).where(T.has_invisible(F.col("line")))
    hits = lines.select(key, "line_no", F.explode(
        F.regexp_extract_all("line", F.lit(T.INVISIBLE), F.lit(0))).alias("ch"))
    code = F.concat(F.lit("U+"), F.lpad(F.hex(F.encode("ch", "UTF-16BE")), 4, "0"))
    return (hits.groupBy(key, code.alias("code_point"))
            .agg(F.count("*").alias("n"), F.min("line_no").alias("first_line")))


def control_violations(df: DataFrame, key: str, exempt: tuple[str, ...] = ()) -> DataFrame:
    """(key, column) of every string that is not one clean line, exempt columns aside."""
    names = [n for n, t in df.dtypes if t == "string" and n not in exempt and n != key]
    bad = F.array_compact(F.array(*[
        F.when(~T.single_line(F.col(n)), F.lit(n)) for n in names]))
    return df.select(F.col(key).cast("string").alias("row_key"), F.explode(bad).alias("column_name"))


# A prompt line and up to eight lines that trailing backslashes join to it; a blank line ends it.
_CANDIDATE = r"(?m)^[ \t\r]*[$#][ \t]+[^\s][^\n]*?(?:\\[ \t\r]*\n[ \t]*(?:[^\s][^\n]*?|(?=\n|\z))){0,8}[ \t\r]*$"


def staged_candidates(files: DataFrame, key: str, text: str) -> DataFrame:
    """Prompt lines of each file with continued lines joined: (key, line_no, prompt, command, joined).

    The joins happen inside the file's row, by one expression; only the candidates' line
    numbers are summed up over the file, whose size its row bounds.
    """
    cut = computed(files.select(key, text), {
        "_found": F.regexp_extract_all(text, F.lit(_CANDIDATE), F.lit(0)), "_between": F.split(text, _CANDIDATE, -1)})
    pairs = F.zip_with("_found", "_between", lambda c, b: F.struct(c.alias("raw"), b.alias("gap")))
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    d = cut.select(key, F.posexplode(F.filter(pairs, lambda p: p["raw"].isNotNull())).alias("_i", "_p"))
    d = computed(d, {"raw": F.col("_p.raw"), "_lines": newlines(F.col("_p.raw")), "_gap": newlines(F.col("_p.gap"))})
    before = Window.partitionBy(key).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("_gap") + F.col("_lines")).over(before), F.lit(0)) + F.col("_gap") + 1
    body = F.regexp_extract("raw", r"(?s)^[ \t\r]*[$#][ \t]+(.*)\z", 1)
    one_line = F.regexp_replace(body, r"[ \t\r]*\\[ \t\r]*\n[ \t]*(?=[^\s])", " ")
    return d.select(key, start.cast("bigint").alias("line_no"), F.regexp_extract("raw", r"[$#]", 0).alias("prompt"),
                    T.escape_invisible(T.strip(one_line)).alias("command"), F.col("_lines").cast("bigint").alias("joined"))
