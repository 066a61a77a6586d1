"""Queries of the mining pipeline: evidence, classification, records, citations, ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanledger.functions import text as T
from spanledger.functions import words as W
from spanledger.functions.hashing import key_id, text_key
from spanledger.operators import classify as C
from spanledger.operators import dedupe as D
from spanledger.operators import ledger as G
from spanledger.operators import overlap as O
from spanledger.operators import records as R
from spanledger.operators.integrity import resolve_anchors
from spanledger.operators.lines import explode_lines, with_prompt
from spanledger.operators.mining import mine
from spanledger.operators.patterns import DESTRUCTIVE, RANK
from spanledger.operators.phrases import phrase_hits
from spanledger.operators.windows import cell_stride_sample
from spanledger.plans.base import (DOC_LINES, LOG, command_log, document_lines, query, sql_list,
                                   sql_strip, sql_tokens, table, texts)
from spanledger.plans.text_plans import SQL_AUDIT, SQL_CONFIG, SQL_PROSE
from spanledger.sources import sinks

CONV_LINES = """
select conv_id, turn, role, cast(i as bigint) as line_no, ls[i] as line from (
  select *, unnest(range(1, len(ls) + 1)) as i from (
    select *, string_split(text, chr(10)) as ls from conversations))
"""


def corpus(spark, sf):
    """Three families: the log, document lines staged behind a '#', and conversation lines."""
    log = command_log(spark, sf).select(
        F.lit("log").alias("family"), "release", F.col("event_id").alias("row_key"),
        F.lit(1).cast("bigint").alias("line_no"), "line")
    docs = document_lines(spark, sf).select(
        F.lit("documents").alias("family"), F.col("lang").alias("release"), F.col("doc_id").alias("row_key"),
        "line_no", F.concat(F.lit("# "), "line").alias("line"))
    talk = explode_lines(texts(spark, sf, "conversations"), "text", "conv_id", "turn", "role").select(
        F.lit("talk").alias("family"), F.col("role").alias("release"),
        F.expr("conv_id * 1000000 + turn").alias("row_key"), "line_no", "line")
    return log.unionByName(docs).unionByName(talk)


def unavailable(spark):
    return spark.createDataFrame([("7", "podman"), ("10", "rsync")], "release string, head string")


CORPUS = f"""
select 'log' as family, release, event_id as row_key, cast(1 as bigint) as line_no, line from ({LOG})
union all select 'documents', lang, doc_id, line_no, '# ' || line from ({DOC_LINES})
union all select 'talk', role, conv_id * 1000000 + turn, line_no, line from ({CONV_LINES})"""

_BASE = "regexp_extract({0}, '([^/]*)$', 1)"
_CMD = r"regexp_matches({0}, '^(/[A-Za-z0-9_.+-]+)*/?[A-Za-z0-9_][A-Za-z0-9_.+-]*$')"
_LOWER = r"regexp_matches({0}, '^[a-z0-9_][a-z0-9_.+-]*$')"
_WORD = r"regexp_matches({0}, '^[A-Za-z][A-Za-z''-]*$')"
_TUI = f"""(len(toks) > 0 and trim(lower(toks[1]), '.,:;') in {sql_list(W.TUI_OPENERS)}
  and len(list_filter(toks[2:], lambda t: trim(lower(t), '.,:;') in {sql_list(W.TUI_WORDS)})) > 0)"""
_SHAPE = f"""case when {_TUI} then 'interactive-tui'
  when {SQL_AUDIT.format('body')} or {SQL_CONFIG.format('body')} then 'config-fragment'
  when {SQL_PROSE} then 'prose'
  when {_CMD.format('tok1')} and {_LOWER.format(_BASE.format('tok1'))} then 'unparseable'
  when body = '' or not {_WORD.format("coalesce(nullif(trim(tok1, '.,:;'), ''), 'x')")} then 'output-fragment'
  else 'prose' end"""
_STAGE = r"""regexp_extract(regexp_replace(body, '^([\s|;]|&&)+', ''),
  '^(?:"[^"]*(?:"|\z)|''[^'']*(?:''|\z)|\$\([^()]*\)|[^|;&"'']|&[^&])+')"""

# One row per non-blank line, with everything the cascade looks at.
HEADED = f"""
select *, {_BASE.format('head_tok')} as head from (
  select *, coalesce(({sql_tokens("regexp_replace(regexp_replace(stage, '^sudo( -u [^ ]+)? +', ''), '^timeout [0-9]+ +', '')")})[1], '') as head_tok
  from (select *, coalesce(toks[1], '') as tok1, trim({_STAGE}) as stage from (
    select *, {sql_tokens('body')} as toks from (
      select *, case when prompt = '' then s when regexp_matches(s, '^[$#][ \\t]+[^ \\t]') then trim(s[2:]) else s[2:] end as body
      from (select *, case when regexp_matches(s, '^[$#][ \\t]+[^ \\t]') then s[1]
                when regexp_matches(s, '^#[A-Za-z0-9_/]') then '#' else '' end as prompt
        from (select *, {sql_strip('line')} as s from ({CORPUS})) where s <> '')))))"""

_EVIDENCE = f"""prompt <> '' and stage <> '' and not regexp_matches(tok1, '^[A-Za-z_][A-Za-z0-9_]*=')
  and {_CMD.format('head_tok')} and {_LOWER.format('head')} and head not in {sql_list(W.REFUSED_HEADS)}
  and not regexp_matches(head, '[.-]$') and not ({SQL_PROSE}) and not {_TUI}
  and (prompt = '$' or len(list_filter(toks[2:], lambda t: regexp_matches(t, '^(-{{1,2}}[A-Za-z0-9]|/[A-Za-z0-9_.]|~/)'))) > 0)"""
_SENTENCE = r"""regexp_matches(regexp_replace(body, '"[^"]*"|''[^'']*''', ' ', 'g'), '(?:^|[^.\pL\pN_])[A-Za-z]{2,}\.\s+[A-Z]')"""
_BIN = "regexp_matches(head_tok, '^(" + "|".join(W.BIN_DIRS) + ")')"
_KNOWN_WORDS = r"""len(list_filter(toks, lambda t: regexp_matches(trim(t, '.,:;'), '^[A-Za-z][A-Za-z''-]*$')))"""

JUDGED = f"""
with h as ({HEADED}),
known as (select distinct head from h where {_EVIDENCE}
  union select head from h where prompt = '$' and {_CMD.format('head_tok')}
  union select unnest([{", ".join("'" + b + "'" for b in W.COMMON_BINARIES)}]))
select family, release, row_key, line_no, line, prompt, case when prompt = '' then s else body end as text, head,
  case when prompt = '' then case when regexp_matches(s, '^#[!#]') then 'config-fragment' else {_SHAPE} end
  when stage = '' then 'output-fragment'
  when regexp_matches(tok1, '^[A-Za-z_][A-Za-z0-9_]*=') then 'config-fragment'
  when lower({_BASE.format('tok1')}) in {sql_list(W.SHELL_KEYWORD_HEADS)} then 'unparseable'
  when lower({_BASE.format('tok1')}) in {sql_list(W.FUNCTION_WORD_HEADS)} then 'prose'
  when regexp_matches(body, '^[A-Za-z_][A-Za-z0-9_.-]*\\s*[{{}}]$') then 'config-fragment'
  when {_SENTENCE} then 'prose'
  when head_tok = '' then 'output-fragment'
  when head in {sql_list(W.REFUSED_HEADS)} then 'unparseable'
  when not {_CMD.format('head_tok')} then {_SHAPE}
  when {SQL_CONFIG.format('body')} then 'config-fragment'
  when head not in (select head from known) and not {_BIN} then
    case when len(toks) > 0 and {_KNOWN_WORDS} >= greatest(2, len(toks) - 1) then 'prose' else {_SHAPE} end
  when prompt = '$' and {SQL_PROSE} then 'prose'
  when prompt <> '$' and (not {_LOWER.format('head')} or {SQL_PROSE} or {_TUI}) then {_SHAPE}
  when (release = '7' and head = 'podman') or (release = '10' and head = 'rsync') then 'binary-not-on-release'
  end as reason
from h"""


def judged(spark, sf):
    return mine(corpus(spark, sf), unavailable(spark))


@query("strong_heads", f"select head, count(*) as support from ({HEADED}) where {_EVIDENCE} group by head")
def strong_heads(spark, sf):
    d = with_prompt(corpus(spark, sf)).where(F.col("prompt") != "")
    return C.strong_heads(d.select("command", "prompt"))


@query("line_reasons", f"""
select family, release, coalesce(reason, 'taken') as reason, count(*) as n from ({JUDGED}) group by all""")
def line_reasons(spark, sf):
    return judged(spark, sf).groupBy("family", "release", F.coalesce("reason", F.lit("taken")).alias("reason")).agg(
        F.count("*").alias("n"))


@query("reason_pivot", f"""
select family, release, {", ".join(f"cast(count(*) filter (where reason = '{r}') as bigint) as {r.replace('-', '_')}" for r in W.RESIDUE_REASONS)}
from ({JUDGED}) where reason is not null group by family, release""")
def reason_pivot(spark, sf):
    return G.reason_pivot(judged(spark, sf))


@query("mine_corpus", f"""
select family, row_key, line_no, prompt, coalesce(reason, '') as reason,
  case when reason is null then head else '' end as tool from ({JUDGED})""")
def mine_corpus(spark, sf):
    return judged(spark, sf).select("family", "row_key", "line_no", "prompt",
                                    F.coalesce("reason", F.lit("")).alias("reason"),
                                    F.coalesce("tool", F.lit("")).alias("tool"))


def mined(spark, sf) -> R.Mined:
    """The whole chain over the corpus: judged lines, records and residue, each written and read back."""
    d = judged(spark, sf).select("family", "release", "text", "tool", "reason", (F.col("family") == "documents").alias("governing"),
                                 (F.col("line_no") % 2 == 1).alias("verbatim_span"))
    return R.Mined(d)


_PEELED = r"""regexp_replace(regexp_replace(regexp_replace(st, '^(sudo -u [^ ]+|nohup|timeout [0-9]+|xargs -n 1) ', ''),
  '^[A-Za-z_][A-Za-z0-9_]*=[^ ]* ', ''), '^(sudo -u [^ ]+|nohup) ', '')"""
_STAGE_HEADS = rf"""list_transform(list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(text, '"[^"]*"', '"Q"', 'g'),
  '\$\([^()]*\)', 'SUB', 'g'), '\|\||&&|\||;'), lambda x: trim(x)), lambda x: x <> ''),
  lambda st: regexp_extract(split_part({_PEELED}, ' ', 1), '([^/]*)$', 1))"""
_TRUNC = """(text <> '' and ((length(text) - length(replace(text, '"', ''))) % 2 = 1
  or (length(text) - length(replace(text, '''', ''))) % 2 = 1 or regexp_matches(text, '[-=,]$')
  or regexp_matches(text, '(^|\\s)--[A-Za-z0-9][A-Za-z0-9-]*$')))"""
_RATED = "greatest(" + ", ".join(
    f"""case when contains(lower(text), '{m.lower()}') or contains(translate(lower(text), '"''', ''), '{m.lower()}') then {RANK[r]} else -1 end"""
    for _, m, r in DESTRUCTIVE) + ")"


@query("mine_records", f"""
with j as materialized (select text, head as tool, family, release, line_no from ({JUDGED}) where reason is null),
c as (select text, string_agg(family || '/' || release || '=' || n, ' ' order by family, release) as cells from (
  select text, family, release, count(*) as n from j group by all) group by text),
r as (select text, tool, count(*) as n, bool_or(family = 'documents') as gov, bool_and(line_no % 2 = 1) as verb,
  string_agg(distinct lpad(cast(length(release) as varchar), 3, '0') || release, ',' order by lpad(cast(length(release) as varchar), 3, '0') || release) as releases
  from j group by text, tool)
select 'ref-' || substr(sha256(text), 1, 16) as id, tool, text, case when gov then 'governing' else 'documentary' end as authority,
  verb and not {_TRUNC} as verbatim_span, {_TRUNC} as truncated,
  case when len({_STAGE_HEADS}) > 1 then array_to_string({_STAGE_HEADS}, '|') else '' end as stages,
  case {_RATED} when 2 then 'red' when 1 then 'yellow' else 'unrated' end as rating,
  regexp_replace(releases, '(^|,)[0-9]{{3}}', '\\1', 'g') as releases, cells, n
from r join c using (text)""")
def mine_records(spark, sf):
    """The finalised records of the corpus: deduped, counted by cell, staged, rated, in the order of the table."""
    cells = F.array_join(F.transform("cells", lambda c: F.concat(c["family"], F.lit("/"), c["release"], F.lit("="), c["n"])), " ")
    return mined(spark, sf).records.withColumns({
        "stages": F.coalesce(F.array_join("stages", "|"), F.lit("")), "releases": F.array_join("releases", ","), "cells": cells})


_LEDGER = f"""
with j as ({JUDGED})
select family, release, count(*) as candidates, cast(count(*) filter (where reason is null) as bigint) as classified,
  cast(count(*) filter (where reason is not null) as bigint) as residue,
  cast(count(*) filter (where reason is null) as bigint) as recorded,
  count(distinct case when reason is null then j.text end) as records,
  cast(count(*) filter (where reason = 'unparseable') as bigint) as unclassified_residue
from j group by family, release"""


def _ledger(spark, sf):
    m = mined(spark, sf)
    source = corpus(spark, sf).where(T.strip(F.col("line")) != "").select("family", "release")
    return R.audit(source, m.judged, m.records, m.residue)


@query("closure_ledger", _LEDGER)
def closure_ledger(spark, sf):
    return _ledger(spark, sf).drop("residue_recount")


@query("ledger_balance", f"""
select l.family, l.release, code from ({_LEDGER}) l, lateral (
  select 'recorded' as code where recorded <> classified union all select 'zero-classified' where classified = 0 and candidates > 0
  union all select 'candidates' where classified + residue <> candidates)""")
def ledger_balance(spark, sf):
    return R.imbalances(_ledger(spark, sf))


@query("residue_rows", f"""
select family, release, reason as r, family || '#' || row_key || '#' || line_no as a, text as x
from ({JUDGED}) where reason is not null""")
def residue_rows(spark, sf):
    d = judged(spark, sf).withColumn("fam", F.col("family"))
    return sinks.residue_rows(d, ["fam", "row_key", "line_no"])


_UNWRAPPED = "ltrim(trim(text))"
for _ in range(3):
    _UNWRAPPED = rf"regexp_replace({_UNWRAPPED}, '^(\S*/)?(sudo|doas|nohup|xargs|timeout)( +-[ugnIPsk] +\S+| +-\S+)*( +[0-9]+)? +', '')"
_REHEADED = _BASE.format(rf"regexp_extract({_UNWRAPPED}, '^[^\s]*')")


@query("reassert", f"""
select family, row_key, line_no, head as tool, objection from (select *, case
  when lower({_BASE.format('w1')}) in {sql_list(W.FUNCTION_WORD_HEADS)} then 'function-word-head'
  when regexp_matches(text, '^\\S+\\s*[{{}}]$') then 'block-opener'
  when regexp_matches(regexp_replace(regexp_replace(text, '"[^"]*"', ' ', 'g'), '''[^'']*''', ' ', 'g'), '(^|[\\s,;(])[A-Za-z]{{2,}}\\.\\s+[A-Z]') then 'two-sentences'
  when prompt = '' then 'source-does-not-mark-a-command'
  when {_REHEADED} <> filed then 'other-head' else '' end as objection
  from (select *, regexp_extract(trim(text), '^[^\\s]*') as w1,
    case when release = '8' and starts_with(text, 'sudo') then 'sudo' when family = 'documents' and row_key % 20 = 0 then 'other' else head end as filed
    from ({JUDGED}) where reason is null)) where objection <> ''""")
def reassert(spark, sf):
    """Taken lines of all families judged again. On release 8 the filed tool is the wrapper, and in some documents
    another program: both must be noticed."""
    d = judged(spark, sf).where(F.col("reason").isNull())
    planted = (F.when((F.col("release") == "8") & F.col("command").startswith("sudo"), "sudo")
               .when((F.col("family") == "documents") & (F.col("row_key") % 20 == 0), "other").otherwise(F.col("tool")))
    out = C.reassert(d.withColumns({"true_tool": F.col("tool"), "tool": planted}))
    return out.where(F.col("objection") != "").select("family", "row_key", "line_no", F.col("true_tool").alias("tool"), "objection")


_HITS = f"""
select 'documents' as family, 'governing' as authority, 'verbatim-ok' as license_class, line_no % 2 = 1 as verbatim_span,
  lang as release, cast(doc_id as varchar) as s, null as g, 'text' as field, line_no, trim(line) as text, 'line' as kind,
  lower(split_part(trim(line), ' ', 1)) as tool, doc_id * 100000 + line_no as seq from ({DOC_LINES}) where trim(line) <> ''
union all select 'talk', 'documentary', 'cc-by', true, role, null, cast(conv_id as varchar), 'turn', line_no, trim(line), 'turn',
  lower(split_part(trim(line), ' ', 1)), 1000000000000000 + (conv_id * 1000 + turn) * 100000 + line_no
  from ({CONV_LINES}) where trim(line) <> ''"""


def _hits(spark, sf):
    line = F.trim("line")
    common = [line.alias("text"), F.lower(F.substring_index(line, " ", 1)).alias("tool"), "line_no"]
    none = F.lit(None).cast("string")
    docs = document_lines(spark, sf).where(line != "").select(
        F.lit("documents").alias("family"), F.lit("governing").alias("authority"),
        F.lit("verbatim-ok").alias("license_class"), (F.col("line_no") % 2 == 1).alias("verbatim_span"),
        F.col("lang").alias("release"), F.col("doc_id").cast("string").alias("s"), none.alias("g"), none.alias("p"),
        F.lit("text").alias("field"), F.lit("line").alias("kind"),
        F.expr("doc_id * 100000 + line_no").alias("seq"), *common)
    talk = explode_lines(texts(spark, sf, "conversations"), "text", "conv_id", "turn", "role").where(line != "").select(
        F.lit("talk").alias("family"), F.lit("documentary").alias("authority"), F.lit("cc-by").alias("license_class"),
        F.lit(True).alias("verbatim_span"), F.col("role").alias("release"), none.alias("s"),
        F.col("conv_id").cast("string").alias("g"), none.alias("p"), F.lit("turn").alias("field"),
        F.lit("turn").alias("kind"),
        F.expr("1000000000000000 + (conv_id * 1000 + turn) * 100000 + line_no").alias("seq"), *common)
    return docs.unionByName(talk)


@query("dedupe_lines", f"""
select 'ref-' || substr(sha256(text), 1, 16) as id, case when gov then 'governing' else 'documentary' end as authority,
  case when gov then 'verbatim-ok' else lic end as license_class, verb and not {_TRUNC} as verbatim_span,
  {_TRUNC} as truncated, kind, tool, releases, families, n
from (select text, count(*) as n, bool_or(authority = 'governing') as gov, bool_and(verbatim_span) as verb,
    arg_min(license_class, seq) as lic, arg_min(kind, seq) as kind, arg_min(tool, seq) as tool,
    string_agg(distinct release, ',' order by release) as releases, string_agg(distinct family, ',' order by family) as families
  from (select family, authority, license_class, verbatim_span, text, kind, tool, seq,
          lpad(cast(length(release) as varchar), 3, '0') || release as release from ({_HITS})) group by text)
""".replace("releases, families, n\nfrom", "regexp_replace(releases, '(^|,)[0-9]{3}', '\\1', 'g') as releases, families, n\nfrom"))
def dedupe_lines(spark, sf):
    return D.dedupe(_hits(spark, sf)).drop("text")


@query("line_citations", f"""
with f as (select text, release, s, g, min(seq) as seq, arg_min(field, seq) as field, arg_min(line_no, seq) as line_no
  from ({_HITS}) group by text, release, s, g)
select 'ref-' || substr(sha256(text), 1, 16) as id, release, coalesce(s, '') as s, coalesce(g, '') as g, field, line_no
from (select *, row_number() over (partition by text, g is null order by seq) as rn from f) where g is null or rn <= 2""")
def line_citations(spark, sf):
    c = D.citations(_hits(spark, sf))
    return c.select(key_id(F.col("key")).alias("id"), "release", F.coalesce("s", F.lit("")).alias("s"),
                    F.coalesce("g", F.lit("")).alias("g"), "field", "line_no")


@query("union_families", f"""
select family, release, count(*) as n_lines, count(distinct text) as n_texts from ({_HITS}) group by all""")
def union_families(spark, sf):
    per_text = _hits(spark, sf).groupBy("family", "release", text_key(F.col("text")).alias("key")).agg(F.count("*").alias("n"))
    return per_text.groupBy("family", "release").agg(
        F.sum("n").alias("n_lines"), F.count("*").alias("n_texts"))


@query("overlap_reattribute", f"""
select text, count(distinct family) as n_families, count(*) as n_lines,
  case when bool_or(authority = 'governing') then 'documents' else 'talk' end as filed_under
from ({_HITS}) group by text having count(distinct family) > 1""")
def overlap_reattribute(spark, sf):
    return O.in_several_families(_hits(spark, sf), "text", "family")


_GRAMS = """
select distinct {key}array_to_string(ws[i:i + 7], ' ') as gram from (
  select {key}ws, unnest(range(1, len(ws) - 6)) as i from (
    select {key}regexp_extract_all(lower(text), '[a-z0-9-]+') as ws from {table}))"""


@query("ngram_overlap", f"""
with own as ({_GRAMS.format(key='doc_id, ', table='documents')}), prot as ({_GRAMS.format(key='', table='benchmark')})
select doc_id, count(*) as shared_grams, min(gram) as first_gram from own semi join prot using (gram) group by doc_id""")
def ngram_overlap(spark, sf):
    return O.ngram_overlap(texts(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "benchmark"), "text")


@query("licensed_overlap", f"""
with rows as (select doc_id as k, text, case when lang = 'en' then 'paraphrase-only' end as field_license,
    case when doc_id % 2 = 0 then 'paraphrase-only' else 'verbatim-ok' end as row_license from documents),
gov as (select k, text from rows where coalesce(field_license, row_license) = 'paraphrase-only'),
own as ({_GRAMS.format(key='k, ', table='gov')}), prot as ({_GRAMS.format(key='', table='benchmark')})
select k, count(*) as shared_grams, min(gram) as first_gram from own semi join prot using (gram) group by k""")
def licensed_overlap(spark, sf):
    """Documents under a licence that forbids verbatim text, by language or by row, against the protected texts."""
    rows = texts(spark, sf, "documents").select(
        F.col("doc_id").alias("k"), "text", F.when(F.col("lang") == "en", "paraphrase-only").alias("field_license"),
        F.when(F.col("doc_id") % 2 == 0, "paraphrase-only").otherwise("verbatim-ok").alias("row_license"))
    return O.ngram_overlap(O.governed_texts(rows), "k", "text", table(spark, sf, "benchmark"), "text")


@query("vocab_coverage", """
with v as (select distinct source, unnest(regexp_extract_all(lower(text), '[a-z0-9-]+')) as w from documents),
b as (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9-]+')) as w from benchmark),
m as (select source, count(*) as missing from v anti join b using (w) group by source),
base as (select source, count(*) * 60 as accepted from documents where source <> 'src0' group by source)
select source, coalesce(missing, -1) as missing, coalesce(accepted, -1) as accepted, case when accepted is null then 'unmeasured'
  when missing is null then 'missing-row' when missing > accepted then 'grew' when missing < accepted then 'improved' else 'held' end as status
from m full join base using (source)""")
def vocab_coverage(spark, sf):
    docs = texts(spark, sf, "documents")
    # Distinct inside each text first: most words leave the map side once per text.
    own = docs.select("source", F.explode(F.array_distinct(T.shingle_words(F.col("text")))).alias("w")).distinct()
    known = table(spark, sf, "benchmark").select(F.explode(T.shingle_words(F.col("text"))).alias("w")).distinct()
    missing = own.join(known, "w", "left_anti").groupBy("source").agg(F.count("*").alias("missing"))
    base = docs.where("source <> 'src0'").groupBy("source").agg((F.count("*") * 60).alias("accepted"))
    status = (F.when(F.col("accepted").isNull(), "unmeasured").when(F.col("missing").isNull(), "missing-row")
              .when(F.col("missing") > F.col("accepted"), "grew")
              .when(F.col("missing") < F.col("accepted"), "improved").otherwise("held"))
    return missing.join(base, "source", "full").select(
        "source", F.coalesce("missing", F.lit(-1)).alias("missing"), F.coalesce("accepted", F.lit(-1)).alias("accepted"),
        status.alias("status"))


@query("anchor_resolve", f"""
with src as (select 'documents' as family, cast(doc_id as varchar) as key, doc_id as k, line_no, line, false as joined from ({DOC_LINES})
  union all select 'talk', conv_id || '.' || turn, conv_id + turn, line_no, line, conv_id % 3 = 0 from ({CONV_LINES})),
c as (select family, key, family || '-' || key || '-' || line_no as claim_id, case (k + line_no) % 50 when 0 then 'x' || text else text end as text,
  line_no + case (k + line_no) % 50 when 1 then 1 when 2 then 100000 else 0 end as line_no, family = 'talk' as exact, verbatim
  from (select family, key, k, line_no, case when family = 'talk' then line else trim(line) end as text, (k + line_no) % 7 <> 0 as verbatim
        from src where trim(line) <> ''))
select claim_id, family, key, line_no, case when s.line is null then 'no-such-line'
    when not (case when exact then line = text else contains(line, text) end) then 'text-not-on-line' else 'verbatim-but-joined' end as reason
from c left join src s using (family, key, line_no)
where s.line is null or not (case when exact then line = text else contains(line, text) end) or (verbatim and joined)""")
def anchor_resolve(spark, sf):
    field, none = F.lit("text").alias("field"), F.lit(None).cast("bigint").alias("line_to")
    docs = texts(spark, sf, "documents").select(
        F.lit("documents").alias("family"), F.col("doc_id").cast("string").alias("key"), field, F.col("text").alias("body"),
        F.lit(False).alias("joined"), F.col("doc_id").alias("k"))
    talk = texts(spark, sf, "conversations").select(
        F.lit("talk").alias("family"), F.concat_ws(".", "conv_id", "turn").alias("key"), field, F.col("text").alias("body"),
        (F.col("conv_id") % 3 == 0).alias("joined"), (F.col("conv_id") + F.col("turn")).alias("k"))
    sources = docs.unionByName(talk)
    lines = explode_lines(sources, "body", "family", "key", "field", "k").where(F.trim("line") != "")
    slot = (F.col("k") + F.col("line_no")) % 50
    text = F.when(F.col("family") == "talk", F.col("line")).otherwise(F.trim("line"))
    claims = lines.select(
        F.concat_ws("-", "family", "key", "line_no").alias("claim_id"), "family", "key", "field",
        (F.col("line_no") + F.when(slot == 1, 1).when(slot == 2, 100000).otherwise(0)).alias("line_no"), none,
        F.when(slot == 0, F.concat(F.lit("x"), text)).otherwise(text).alias("text"),
        ((F.col("k") + F.col("line_no")) % 7 != 0).alias("verbatim"), (F.col("family") == "talk").alias("exact"))
    return resolve_anchors(claims, sources.drop("k")).select("claim_id", "family", "key", "line_no", "reason")


_PHRASES = """select item_id as phrase_id, array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') as phrase,
  case when item_id % 3 = 0 then 2 else 1 end as rank from benchmark"""


@query("phrase_rating", f"""
select doc_id, line_no, count(*) as phrases, max(rank) as rank from (select doc_id, line_no, lower(line) as low,
  translate(lower(line), '"''', '') as bare from ({DOC_LINES})) l join ({_PHRASES}) p
on contains(low, lower(phrase)) or contains(bare, lower(phrase)) where phrase <> '' group by doc_id, line_no""")
def phrase_rating(spark, sf):
    """Lines of the documents that hold the opening words of benchmark items, with the highest rank of these."""
    items = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("phrase_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("phrase"),
        F.when(F.col("item_id") % 3 == 0, 2).otherwise(1).alias("rank"))
    hits = phrase_hits(document_lines(spark, sf).select("doc_id", "line_no", "line"), ["doc_id", "line_no"], "line", items)
    return hits.join(items.select("phrase_id", "rank"), "phrase_id").groupBy("doc_id", "line_no").agg(
        F.count("*").alias("phrases"), F.max("rank").alias("rank"))


@query("cell_stride_sample", f"""
with r as (select lang, source, doc_id, line_no, row_number() over (partition by lang, source order by doc_id, line_no) as rank,
  count(*) over (partition by lang, source) as n from ({DOC_LINES})),
w as (select *, greatest(1, n // least(n, greatest(20, n // 100))) as step from r)
select lang, source, doc_id, line_no, rank, cast(step as bigint) as step from w where (rank - 1) % step = 0""")
def cell_stride_sample_q(spark, sf):
    d = document_lines(spark, sf).select("lang", "source", "doc_id", "line_no")
    out = cell_stride_sample(d, ["lang", "source"], ["doc_id", "line_no"], F.expr("doc_id div 1024"))
    return out.select("lang", "source", "doc_id", "line_no", "rank", F.col("step").cast("bigint").alias("step"))
