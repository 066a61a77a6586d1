"""The ordered classification cascade and the evidence it rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions import text as T
from spanledger.functions import words as W
from spanledger.operators.support import computed


def _early_verdict(c: Column) -> Column:
    """The rules that need no more than the text, its first stage and its first token."""
    raw_head = F.lower(T.basename(F.col("_first")))
    return (
        F.when(F.col("_odd"), "unparseable")
        .when(F.col("_stage") == "", "output-fragment")
        .when(F.col("_first").rlike(T.ENV_ASSIGN), "config-fragment")
        .when(raw_head.isin(W.SHELL_KEYWORD_HEADS), "unparseable")
        .when(raw_head.isin(W.FUNCTION_WORD_HEADS), "prose")
        .when(T.strip(c).rlike(T.BLOCK_OPENER), "config-fragment")
        .when(T.sentence_like(c), "prose"))


def examined(lines: DataFrame, decide: bool = True) -> DataFrame:
    """Adds all that is known of a line without the evidence: what ``evidence_of`` counts and ``decided`` needs.

    ``lines`` needs ``command`` and ``prompt``; a column ``preset`` may hold reasons already known, or ``by-shape``. The
    costly columns are worked out only for lines that the early rules leave open or that can be evidence. Without
    ``decide`` the lines are evidence alone.
    """
    c = F.col("command")
    given = F.col("preset") if "preset" in lines.columns else F.lit(None).cast("string")
    at_dollar = F.col("prompt") == "$"
    # Only such lines can be evidence; the test is cheap and comes before the costly ones.
    maybe = given.isNull() & (F.col("prompt") != "") & (at_dollar | c.rlike(
        rf"[{T.SPACE}](?:-{{1,2}}[A-Za-z0-9]|/[A-Za-z0-9_.]|~/)"))
    d = computed(lines, {"_stage": T.first_stage(c), "_first": T.first_token(c), "_odd": T.has_invisible(c), "_maybe": maybe})
    d = computed(d, {"_early": F.when(given.isNotNull(), given).otherwise(_early_verdict(c)) if decide else F.lit("")})
    is_open = F.col("_early").isNull()
    d = computed(d, {"_toks": F.when(is_open | F.col("_maybe") | (F.col("_early") == "by-shape"), T.tokens(c)),
                     "_head_tok": F.when(is_open | F.col("_maybe"), T.command_head(F.col("_stage")))})
    d = computed(d, {"_prose": F.coalesce(T.prose_like(F.col("_toks")), F.lit(False)),
                     "_tui": F.coalesce(T.tui_like(F.col("_toks")), F.lit(False)),
                     "_head": T.basename(F.col("_head_tok"))})
    sound = ~F.col("_odd") & ~F.col("_first").rlike(T.ENV_ASSIGN)
    shaped = (F.col("_head").rlike(T.LOWER_BASENAME) & ~F.col("_head").isin(W.REFUSED_HEADS)
              & ~F.col("_head").rlike(r"[.-]\z") & ~F.col("_prose") & ~F.col("_tui"))
    told = {"_counts": F.col("_maybe") & F.col("_head_tok").rlike(T.COMMAND_TOKEN),
            "_shown": F.col("_maybe") & sound & shaped & (at_dollar | T.has_evidence_token(F.col("_toks")))}
    if decide:
        unsettled = is_open | (F.col("_early") == "by-shape")
        told |= {"_shape": F.when(unsettled, T.residue_reason(c, F.col("_toks"), F.col("_prose"), F.col("_tui"))),
                 "_mostly": F.when(is_open, T.mostly_words(F.col("_toks")))}
    return computed(d, told).drop("preset", "_stage", "_first", "_odd", "_maybe", "_toks")


def evidence_of(known: DataFrame) -> DataFrame:
    """Per head of examined lines: ``in_vocab`` and ``support``.

    A head is in the vocabulary when some '$' prompt shows it. Its support counts the lines
    that show it being run: lines behind '$' or with an option or path token that are
    neither a sentence nor an instruction. Counting combines on the map side.
    """
    at_dollar = F.col("prompt") == "$"
    return (known.where(F.col("_counts") & (at_dollar | F.col("_shown"))).groupBy(F.col("_head").alias("head"))
            .agg(F.bool_or(at_dollar).alias("in_vocab"), F.count_if("_shown").alias("support")))


def head_evidence(candidates: DataFrame) -> DataFrame:
    """The evidence of lines that are no more than that: (command, prompt)."""
    return evidence_of(examined(candidates, decide=False))


def strong_heads(candidates: DataFrame) -> DataFrame:
    """Heads the corpus shows being run, with the number of lines that show it."""
    return head_evidence(candidates).where(F.col("support") > 0).select("head", "support")


def decided(known: DataFrame, evidence: DataFrame, unavailable: DataFrame,
            trusted: list[str] = W.COMMON_BINARIES, policy: str = "lowercase") -> DataFrame:
    """Adds ``tool`` (set when the line is a command) and ``reason`` (set when it is not) to examined lines.

    ``known`` needs ``release``; ``evidence`` comes from ``evidence_of``. What is known of a head, and the
    (release, head) exclusions, come from left joins.
    """
    heads = evidence.select(F.col("head").alias("_key"), F.col("in_vocab").alias("_in_vocab"),
                            (F.col("support") > 0).alias("_in_strong"))
    absent = unavailable.select("release", F.col("head").alias("_key"),
                                F.lit(True).alias("_absent")).distinct()
    # Lines decided early meet no head: their keys are spread, so that they do not share a partition.
    spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("command"), F.lit(4096)).cast("string"))
    d = known.withColumn("_key", F.when(F.col("_early").isNull(), F.col("_head")).otherwise(spread))
    d = d.join(heads, "_key", "left").join(absent, ["release", "_key"], "left")
    c, head = F.col("command"), F.col("_head")
    vocab = (F.coalesce("_in_vocab", F.lit(False)) | head.isin(trusted)
             | T.in_bin_dir(F.col("_head_tok")))
    is_known = vocab | F.coalesce("_in_strong", F.lit(False))
    lowercase = policy != "vocabulary"
    plain = (F.col("_prose") | F.col("_tui") | ~head.rlike(T.LOWER_BASENAME)) if lowercase else ~vocab
    # The first rule that fires decides. Two markers defer to the shape of the line:
    # by-shape, and by-evidence for unknown heads.
    verdict = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(F.col("_head_tok") == "", "output-fragment")
        .when(head.isin(W.REFUSED_HEADS), "unparseable")
        .when(~F.col("_head_tok").rlike(T.COMMAND_TOKEN), "by-shape")
        .when(T.strip(c).rlike(T.CONFIG_LINE), "config-fragment")
        .when(~is_known, "by-evidence")
        .when((F.col("prompt") == "$") & F.col("_prose"), "prose")
        .when((F.col("prompt") != "$") & plain, "by-shape")
        .when(F.coalesce("_absent", F.lit(False)), "binary-not-on-release"))
    d = computed(d, {"_verdict": verdict})
    reason = (F.when((F.col("_verdict") == "by-evidence") & F.col("_mostly"), "prose")
              .when(F.col("_verdict").isin("by-shape", "by-evidence"), F.col("_shape")).otherwise(F.col("_verdict")))
    d = computed(d, {"reason": reason})
    return (d.withColumn("tool", F.when(F.col("reason").isNull(), head))
            .drop(*[n for n in d.columns if n.startswith("_")]))


def closed_reason(reason):
    """Any reason outside the closed set counts as unparseable; null stays null."""
    return (F.when(reason.isNull(), None).when(reason.isin(W.RESIDUE_REASONS), reason)
            .otherwise("unparseable"))


def reassert(df: DataFrame) -> DataFrame:
    """A second, independent judgement of classified lines, in plain string terms.

    Adds ``objection``: '' when this rule set agrees that ``command`` runs ``tool``. It
    shares no expression with the cascade: words come from a plain split, wrappers are
    peeled by replacement, sentences are found by their end mark.
    """
    words = F.split(F.trim("command"), r"\s+")
    first = F.substring_index(F.element_at(words, 1), "/", -1)
    peeled = F.trim("command")
    for _ in range(3):
        peeled = F.regexp_replace(
            peeled, r"^(\S*/)?(sudo|doas|nohup|xargs|timeout)( +-[ugnIPsk] +\S+| +-\S+)*( +[0-9]+)? +", "")
    head = F.substring_index(F.split(peeled, r"\s+")[0], "/", -1)
    unquoted = F.regexp_replace(F.regexp_replace("command", '"[^"]*"', " "), "'[^']*'", " ")
    return df.withColumn("objection", (
        F.when(F.lower(first).isin(W.FUNCTION_WORD_HEADS), "function-word-head")
        .when(F.col("command").rlike(r"^\S+\s*[{}]$"), "block-opener")
        .when(unquoted.rlike(r"(^|[\s,;(])[A-Za-z]{2,}\.\s+[A-Z]"), "two-sentences")
        .when(F.col("prompt") == "", "source-does-not-mark-a-command")
        .when(head != F.col("tool"), "other-head")
        .otherwise("")))
