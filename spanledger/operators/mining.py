"""Mining option lists, sections and commands out of manual-style text and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.functions import text as T
from spanledger.functions import words as W
from spanledger.operators import classify as C
from spanledger.operators.census import mode_per_group
from spanledger.operators.lines import explode_lines, with_prompt
from spanledger.operators.support import computed, dealt, settled
from spanledger.operators.windows import forward_fill

HEADING = r"^[A-Z][A-Z0-9 '/-]{1,60}$"
MAN_HEADING = r"^[A-Z][A-Z0-9 ,/'-]*$"


def section_lines(pages: DataFrame, key: str, text: str, heading: str = HEADING) -> DataFrame:
    """Lines of each page with the heading they stand under and its line, ``section_at``.

    Heading lines are dropped; lines before the first heading have no section.
    """
    lines = explode_lines(pages, text, key)
    is_heading = F.col("line").rlike(r"^\S") & T.strip(F.col("line")).rlike(heading)
    d = computed(lines, {"_h": F.when(is_heading, F.struct(
        F.col("line_no").alias("at"), T.strip(F.col("line")).alias("name")))})
    d = forward_fill(d, [key], "line_no", F.col("_h"), "_s").where(F.col("_h").isNull())
    return d.select(*lines.columns, F.col("_s.name").alias("section"), F.col("_s.at").alias("section_at"))


def _preference(section: Column) -> Column:
    return (F.when(section.contains("OPTIONS"), 0).when(section == "DIRECTIVES", 1)
            .when(section == "GLOBAL DIRECTIVES", 2).when(section == "DESCRIPTION", 3).otherwise(4))


def _metavar(rest: Column) -> Column:
    """True when the words behind an option name an argument, not a description."""
    head = F.coalesce(F.get(rest, F.lit(0)), F.lit(""))
    placeholder = head.rlike(r"^(\[?<?[A-Z0-9_]{2,24}>?\]?|<[^>]{1,24}>|\[[^\]]{1,24}\])$")
    plain = F.forall(rest, lambda w: ~w.rlike("[.,;:]$") & w.rlike(r"^[A-Za-z][A-Za-z0-9_/.=-]{0,23}$")
                     & ~F.rtrim(F.lower(w), F.lit("().")).isin(W.DESCRIPTION_VERBS))
    return (F.size(rest) > 0) & (placeholder | ((F.size(rest) <= 3) & plain))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, rf"[{T.SPACE}]+"), lambda w: w != "")


def definition_list(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(page, line, names, takes_arg, kind) of each definition-list term of a page.

    Terms stand in the page's most useful section at its most common term indent. Terms
    that name no option are kind ``unparsed``; a page without any term gives one ``hint``
    row of the dash tokens in its prose.
    """
    lines = computed(section_lines(pages, key, text), {
        "_s": T.strip(F.col("line")), "_indent": F.length("line") - F.length(F.ltrim("line")),
        "_pref": _preference(F.coalesce("section", F.lit("")))})
    # All sections about options count, of the others the first one only. A page without any
    # is read from its first heading on, and one without headings as a whole.
    best = lines.groupBy(key).agg(F.min("_pref").alias("_best"),
                                  F.min(F.struct("_pref", "section_at")).getField("section_at").alias("_first_at"),
                                  F.count("section_at").alias("_titled"))
    inside = (F.when(F.col("_best") == 0, F.col("_pref") == 0)
              .when(F.col("_best") < 4, F.col("section_at") == F.col("_first_at"))
              .otherwise(F.col("section_at").isNotNull() | (F.col("_titled") == 0)))
    body = lines.join(best, key).where(inside)
    w = Window.partitionBy(key, "section_at").orderBy("line_no")
    prior = F.last(F.when(F.col("_s") != "", F.struct("_s", "_indent")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, -1))
    # A chosen section starts as if after a blank line; in the fallback a heading stands before it.
    opening = F.when((F.col("_best") == 4) & F.col("section_at").isNotNull(), "heading").otherwise("")
    body = body.withColumns({"_before": F.coalesce(F.lag("_s").over(w), opening), "_prior": prior})
    # Terms, their common indent and the hints all read these lines, so they are kept once; a page's lines stay together.
    body = dealt(settled(body.select(key, "line_no", "line", "section", "_s", "_indent", "_before", "_prior")), key)
    wrapped = F.col("_prior._s").startswith("[--") & (F.col("_prior._indent") == F.col("_indent"))
    n_words = F.size(_words(F.col("_s")))
    first = F.rtrim(F.lower(F.regexp_extract("_s", r"^[^\s,]*", 0)), F.lit(".:"))
    dashed = F.col("_s").startswith("-")
    terms = body.where(
        (F.col("_s") != "") & (F.col("_indent") > 0)
        & ((F.col("_before") == "") | F.coalesce(wrapped, F.lit(False)))
        & F.col("_s").rlike(r"^[-\p{L}]") & ~first.isin(W.SENTENCE_STARTERS)
        & ~F.col("_s").rlike(r"(?i)^(added|deprecated|removed|changed)\b.*\bversion\b")
        & F.when(dashed, n_words <= 24).otherwise(n_words <= 6))
    terms = terms.select(key, "line_no", "section", "_s", "_indent")
    common = mode_per_group(terms, key, "_indent").select(key, F.col("_indent").alias("_mode"))
    terms = terms.join(common, key).where(F.col("_indent") == F.col("_mode"))

    pieces = F.transform(F.split("_s", r",\s*(?=-)"), _words)
    flag = F.transform(pieces, lambda p: F.coalesce(F.get(p, F.lit(0)), F.lit("")))
    names = F.transform(flag, lambda f: F.when(
        f.contains("="), F.regexp_replace(F.substring_index(f, "=", 1), r"[^\w-]+$", "")).otherwise(f))
    takes = (F.exists(flag, lambda f: f.contains("="))
             | F.exists(pieces, lambda p: _metavar(F.slice(p, 2, 1 << 30))))
    words = _words(F.col("_s"))
    directive = words[0].rlike(r"^[A-Za-z][A-Za-z0-9_.-]{0,39}$")
    is_option = F.col("_s").startswith("-")
    parsed = F.when(is_option, F.forall(flag, lambda f: f.startswith("-"))).otherwise(directive)
    out = terms.select(
        key, "line_no", "section",
        F.when(~parsed, F.col("_s")).when(is_option, F.array_join(names, ","))
        .otherwise(words[0]).alias("names"),
        F.when(parsed, F.when(is_option, takes).otherwise(F.size(words) > 1))
        .otherwise(False).alias("takes_arg"),
        F.when(parsed, "term").otherwise("unparsed").alias("kind"))
    loose = body.join(terms.select(key).distinct(), key, "left_anti").select(
        key, F.explode(F.regexp_extract_all("line", F.lit(r"(?<![\w-])(-{1,2}[A-Za-z][\w-]*)"), F.lit(1))).alias("tok"))
    hints = loose.distinct().groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list("tok")), ", ").alias("names"))
    return out.unionByName(hints.select(
        key, F.lit(0).cast("bigint").alias("line_no"), F.lit(None).cast("string").alias("section"),
        "names", F.lit(False).alias("takes_arg"), F.lit("hint").alias("kind")))


def help_options(pages: DataFrame, key: str, text: str) -> DataFrame:
    """Options of --help output: the first line for each list of names, with takes_arg.

    A line that begins with a dash but names no option is ``unparsed``, each one for itself; indented by
    more than four it belongs to a description and is left out.
    """
    lines = explode_lines(pages, text, key).withColumn("_s", T.strip(F.col("line")))
    spec = F.split("_s", r"\s{2,}", 2)[0]
    d = lines.where(F.col("_s").startswith("-")).withColumn("_spec", spec)
    found = F.regexp_extract_all("_spec", F.lit(r"-{1,2}[A-Za-z0-9][\w-]*(?:=\S+)?"), F.lit(0))
    d = d.withColumn("_found", found)
    names = F.array_join(F.transform("_found", lambda t: F.substring_index(t, "=", 1)), ",")
    rest = _words(F.regexp_replace("_spec", r"-{1,2}[A-Za-z0-9][\w-]*(?:=\S+)?", " "))
    takes = F.exists("_found", lambda t: t.contains("=")) | _metavar(rest)
    kind = F.when(F.size("_found") == 0, "unparsed").otherwise("option")
    indent = F.length("line") - F.length(F.ltrim("line"))
    d = d.where((F.size("_found") > 0) | (indent <= 4)).select(
        key, "line_no", F.when(F.size("_found") == 0, F.col("_s")).otherwise(names).alias("names"),
        takes.alias("takes_arg"), kind.alias("kind"))
    first = F.min(F.struct("line_no", "takes_arg")).alias("_f")
    alone = F.when(F.col("kind") == "unparsed", F.col("line_no")).alias("_alone")
    return d.groupBy(key, "kind", "names", alone).agg(first).select(
        key, "kind", "names", F.col("_f.line_no").alias("line_no"), F.col("_f.takes_arg").alias("takes_arg"))


def described_options(pages: DataFrame, key: str, text: str) -> DataFrame:
    """Options of --help output with the description lines that follow them joined on."""
    lines = explode_lines(pages, text, key).withColumn("_s", T.strip(F.col("line")))
    opening = F.col("_s").startswith("-")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("_option", F.sum(opening.cast("int")).over(w))
    keep = opening | (F.col("line").startswith("    ") & (F.col("_s") != ""))
    d = d.where((F.col("_option") > 0) & keep)
    columns = F.split("_s", r"\s{2,}", 2)
    part = F.when(opening, F.coalesce(F.get(columns, F.lit(1)), F.lit(""))).otherwise(F.col("_s"))
    # One group is one option of one page, so its lines come from a single row.
    text_of = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("line_no", part.alias("p")))),
                                                lambda x: x["p"]), lambda p: p != ""), " ")
    return d.groupBy(key, F.col("_option").alias("option_no")).agg(
        F.max(F.when(opening, columns[0])).alias("option"), text_of.alias("description"))


def section_commands(pages: DataFrame, key: str, text: str, own_name: str) -> DataFrame:
    """SYNOPSIS, EXAMPLES and USAGE lines; ``taken`` when they run the page's own program."""
    lines = (section_lines(pages.select(key, text), key, text, MAN_HEADING)
             .join(pages.select(key, F.col(own_name).alias("_own")), key))
    usage = F.regexp_extract("line", r"^\s*(?:[Uu]sage|USAGE):\s*(\S.*)$", 1)
    inside = F.col("section").isin("SYNOPSIS", "EXAMPLES")
    d = lines.withColumn("command", F.when(inside, T.strip(F.col("line"))).otherwise(usage))
    d = d.where(F.col("command") != "").withColumn(
        "head", T.basename(T.command_head(T.first_stage(F.col("command")))))
    return d.select(key, "line_no", F.when(inside, F.col("section")).otherwise("USAGE").alias("section"),
                    "command", (F.col("head") == F.col("_own")).alias("taken"))


def mine(lines: DataFrame, unavailable: DataFrame, trusted: list[str] = W.COMMON_BINARIES,
         policy: str = "lowercase") -> DataFrame:
    """Two-pass mining: evidence first, then the cascade over every line.

    ``lines``: family, release, line and anchor columns. The first pass examines each line once and stores what it
    found; the second joins the corpus' distinct heads to that. Adds prompt, command, text,
    tool and reason (null when taken). Lines without a prompt are declined by shape.
    """
    d = computed(lines, {"text": T.strip(F.col("line"))}).where(F.col("text") != "")
    banner, prompted = F.col("text").rlike("^#[!#]"), F.col("command") != ""
    d = computed(with_prompt(d), {"preset": F.when(banner, "config-fragment").when(~prompted, "by-shape")})
    d = d.withColumn("command", F.when(F.col("preset").isNull(), F.col("command")).otherwise(F.col("text")))
    known = settled(C.examined(d.drop("text", "line")))
    judged = C.decided(known, settled(C.evidence_of(known)), unavailable, trusted, policy)
    return judged.withColumn("text", F.col("command"))
