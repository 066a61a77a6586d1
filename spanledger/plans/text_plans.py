"""Queries over lines and texts: explode, test, clean, escape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.functions import hashing as H
from spanledger.functions import text as T
from spanledger.functions import words as W
from spanledger.operators import lines as L
from spanledger.operators.support import computed
from spanledger.plans.base import (DOC_LINES, LOG, LOG_COMMANDS, TEXT_KEYS, command_log, document_lines, query,
                                   sql_list, sql_strip, sql_tokens, table, texts)


@query("corpus_lines", f"select doc_id, line_no, line from ({DOC_LINES})")
def corpus_lines(spark, sf):
    return document_lines(spark, sf).select("doc_id", "line_no", "line")


@query("anchored_lines", """
with f as (
  select 'documents' as tbl, doc_id as row_key, 'text' as field, text as body from documents
  union all select 'documents', doc_id, 'source', source from documents
  union all select 'conversations', conv_id * 1000000 + turn, 'text', text from conversations
  union all select 'conversations', conv_id * 1000000 + turn, 'role', role from conversations),
l as (select tbl, row_key, field, cast(i as bigint) as line_no, trim(ls[i]) as text
      from (select *, unnest(range(1, len(ls) + 1)) as i
            from (select *, string_split(body, chr(10)) as ls from f)))
select *, case when regexp_matches(text, '^#[!#]') then 'config-fragment' else 'line' end as route
from l where text <> ''""")
def anchored_lines(spark, sf):
    docs = L.anchored_lines(texts(spark, sf, "documents"), "doc_id", ["text", "source"])
    turns = texts(spark, sf, "conversations").withColumn("k", F.expr("conv_id * 1000000 + turn"))
    conv = L.anchored_lines(turns, "k", ["text", "role"])
    return (docs.withColumn("tbl", F.lit("documents"))
            .unionByName(conv.withColumn("tbl", F.lit("conversations")))
            .select("tbl", "row_key", "field", "line_no", "text", "route"))


@query("prompt_lines", f"select event_id, prompt, command from ({LOG_COMMANDS}) where prompt <> ''")
def prompt_lines(spark, sf):
    return (L.with_prompt(command_log(spark, sf)).where(F.col("prompt") != "")
            .select("event_id", "prompt", "command"))


SQL_PROSE = f"""
  len(toks) >= 4
  and len(list_filter(toks[2:], lambda t: regexp_matches(t, '^[-/~"''<]|[=|$]'))) = 0
  and len(list_filter(toks, lambda t: regexp_matches(t, '^[A-Za-z][A-Za-z''-]*$')
        and lower(t) in {sql_list(W.PROSE_STOPWORDS)})) >= 2"""


@query("prose_lines", f"""
select lang, source, cast(count(*) as bigint) as n_lines,
  cast(count(*) filter (where {SQL_PROSE}) as bigint) as n_prose
from (select lang, source, {sql_tokens('line')} as toks from ({DOC_LINES})) group by all""")
def prose_lines(spark, sf):
    d = computed(document_lines(spark, sf), {"toks": T.tokens(F.col("line"))})
    return d.groupBy("lang", "source").agg(
        F.count("*").alias("n_lines"), F.count_if(T.prose_like(F.col("toks"))).alias("n_prose"))


@query("sentence_lines", f"""
select doc_id, line_no, line from (
  select *, regexp_replace(regexp_replace(line, '"[^"]*"|''[^'']*''', ' ', 'g'), '“[^”]*”', ' ', 'g') as q
  from ({DOC_LINES}))
where regexp_matches(q, '(?:^|[^.\\pL\\pN_])[A-Za-z]{{2,}}\\.\\s+[A-Z]')""")
def sentence_lines(spark, sf):
    return document_lines(spark, sf).where(T.sentence_like(F.col("line"))).select(
        "doc_id", "line_no", "line")


def _all_lines(spark, sf):
    docs = document_lines(spark, sf).select(
        F.lit("documents").alias("family"), F.col("doc_id").alias("row_key"), "line_no", "line")
    log = command_log(spark, sf).select(
        F.lit("log").alias("family"), F.col("event_id").alias("row_key"),
        F.lit(1).cast("bigint").alias("line_no"), "line")
    return docs.unionByName(log)


ALL_LINES = f"""
select 'documents' as family, doc_id as row_key, line_no, line from ({DOC_LINES})
union all select 'log', event_id, cast(1 as bigint), line from ({LOG})"""


@query("tui_lines", f"""
select family, row_key, line_no from (
  select *, list_transform({sql_tokens('line')}, lambda t: trim(lower(t), '.,:;')) as ts from ({ALL_LINES}))
where len(ts) > 0 and ts[1] in {sql_list(W.TUI_OPENERS)}
  and len(list_filter(ts[2:], lambda t: t in {sql_list(W.TUI_WORDS)})) > 0""")
def tui_lines(spark, sf):
    d = computed(_all_lines(spark, sf), {"toks": T.tokens(F.col("line"))})
    return d.where(T.tui_like(F.col("toks"))).select("family", "row_key", "line_no")


SQL_CONFIG = (r"(regexp_matches({0}, '^[A-Za-z_][A-Za-z0-9_.-]*[ \t]+[:=]([ \t]|$)') "
              r"or regexp_matches({0}, '^[A-Za-z_][A-Za-z0-9_.-]*:[ \t]'))")
SQL_AUDIT = r"regexp_matches({0}, '^-[aAwWFkSD]\b')"
SQL_BLOCK = r"regexp_matches({0}, '^[A-Za-z_][A-Za-z0-9_.-]*\s*[{{}}]$')"


@query("config_lines", f"""
select family, row_key, line_no, kind from (
  select *, case when {SQL_AUDIT.format('s')} then 'audit-rule' when {SQL_CONFIG.format('s')} then 'directive'
            when {SQL_BLOCK.format('s')} then 'block' else '' end as kind
  from (select *, {sql_strip('line')} as s from ({ALL_LINES}))) where kind <> ''""")
def config_lines(spark, sf):
    s = T.strip(F.col("line"))
    kind = (F.when(s.rlike(T.AUDIT_RULE), "audit-rule").when(s.rlike(T.CONFIG_LINE), "directive")
            .when(s.rlike(T.BLOCK_OPENER), "block").otherwise(""))
    return (_all_lines(spark, sf).withColumn("kind", kind).where(F.col("kind") != "")
            .select("family", "row_key", "line_no", "kind"))


@query("head_refusals", f"""
select family, refusal, cast(count(*) as bigint) as n from (
  select family, case when regexp_matches(tok, '^[A-Za-z_][A-Za-z0-9_]*=') then 'assignment'
    when lower(head) in {sql_list(W.SHELL_KEYWORD_HEADS)} then 'shell-keyword'
    when lower(head) in {sql_list(W.FUNCTION_WORD_HEADS)} then 'function-word'
    when head in {sql_list(W.REFUSED_HEADS)} then 'wrapper-shell' else 'accepted' end as refusal
  from (select *, regexp_extract(tok, '([^/]*)$', 1) as head from (
    select family, coalesce(({sql_tokens("regexp_replace(line, '^ *[$#][ \\t]+', '')")})[1], '') as tok
    from ({ALL_LINES})))) group by all""")
def head_refusals(spark, sf):
    d = _all_lines(spark, sf)
    body = F.regexp_replace("line", r"^ *[$#][ \t]+", "")
    return (d.withColumn("refusal", L.head_refusal(T.first_token(body)))
            .groupBy("family", "refusal").agg(F.count("*").alias("n")))


@query("truncated_lines", f"""
select family, row_key, line_no, line from (
  select *, coalesce(list_extract({sql_tokens('t')}, -1), '') as last_tok
  from (select *, rtrim(line, ' ' || chr(9) || chr(13)) as t from ({ALL_LINES})))
where t <> '' and ((length(t) - length(replace(t, '"', ''))) % 2 = 1
  or (length(t) - length(replace(t, '''', ''))) % 2 = 1 or regexp_matches(t, '[-=,]$')
  or (regexp_matches(last_tok, '^--[A-Za-z0-9][A-Za-z0-9-]*$')
      and last_tok not in {sql_list(W.NO_VALUE_LONG_OPTIONS)}))""")
def truncated_lines(spark, sf):
    return _all_lines(spark, sf).where(T.looks_truncated(F.col("line"))).select(
        "family", "row_key", "line_no", "line")


# Texts with marks planted by their own content: the bodies stay whole and hold a few
# characters that must be found, and a leading byte order mark that must not.
PLANT = """case id % 5 when 0 then concat({bom}, body) when 1 then concat(body, {zw}, {zw})
  when 2 then concat({zw}, body, {bom}) when 3 then concat('a', {nl}, 'b', {rtl}, body) else body end"""
_SPARK_PLANT = PLANT.format(bom="decode(unhex('EFBBBF'), 'UTF-8')", zw="decode(unhex('E2808B'), 'UTF-8')",
                            rtl="decode(unhex('E280AE'), 'UTF-8')", nl="decode(unhex('0A'), 'UTF-8')")
_SQL_PLANT = PLANT.format(bom="chr(65279)", zw="chr(8203)", rtl="chr(8238)", nl="chr(10)")


def _planted(spark, sf):
    return texts(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body")).select(
        "id", F.expr(_SPARK_PLANT).alias("body"))


PLANTED = f"(select id, {_SQL_PLANT} as body from (select doc_id as id, text as body from documents))"
_RE2_INVISIBLE = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in W.INVISIBLE_RANGES) + "]"


@query("invisible_chars", f"""
select id, code_point, cast(count(*) as bigint) as n, min(line_no) as first_line from (
  select id, line_no, 'U+' || lpad(upper(to_hex(ord(ch))), 4, '0') as code_point from (
    select id, cast(i as bigint) as line_no,
      unnest(regexp_extract_all(ls[i], '{_RE2_INVISIBLE}')) as ch
    from (select id, ls, unnest(range(1, len(ls) + 1)) as i from (
      select id, string_split(case when body[1] = chr(65279) then body[2:] else body end, chr(10)) as ls
      from {PLANTED})))) group by all""")
def invisible_chars(spark, sf):
    return L.invisible_hits(_planted(spark, sf), "id", "body")


@query("escaped_text", f"""
select id, sha256(replace(replace(replace(body, chr(65279), '\\uFEFF'), chr(8203), '\\u200B'),
  chr(8238), '\\u202E')) as digest from {PLANTED}""")
def escaped_text(spark, sf):
    return _planted(spark, sf).select("id", F.sha2(T.escape_invisible(F.col("body")), 256).alias("digest"))


# Every table that has strings, with its key.
STRING_TABLES = {
    "documents": ("doc_id", ["text", "lang", "source"]), "customer": ("c_custkey", ["c_name", "c_mktsegment"]),
    "part": ("p_partkey", ["p_name", "p_brand", "p_type"]), "orders": ("o_orderkey", ["o_orderstatus", "o_orderpriority"]),
    "supplier": ("s_suppkey", ["s_name"]), "nation": ("n_nationkey", ["n_name"]), "region": ("r_regionkey", ["r_name"]),
    "lineitem": ("l_orderkey", ["l_returnflag", "l_linestatus"]), "events": ("event_id", ["event_type", "props"]),
    "conversations": ("conv_id", ["role", "text"]), "pages": ("page_id", ["url", "html"]), "benchmark": ("item_id", ["text"])}


@query("single_line_check", " union all ".join(
    f"select '{t}' as tbl, cast({key} as varchar) as row_key, '{c}' as column_name from {t} "
    f"where regexp_matches({c}, '[\\x00-\\x1f\\x7f-\\x{{9f}}\\x{{2028}}\\x{{2029}}]')"
    for t, (key, columns) in STRING_TABLES.items() for c in columns))
def single_line_check(spark, sf):
    """Control characters in every string column of every table."""
    parts = []
    for name, (key, _) in STRING_TABLES.items():
        rows = texts(spark, sf, name) if name in TEXT_KEYS else table(spark, sf, name)
        parts.append(L.control_violations(rows, key).select(F.lit(name).alias("tbl"), "row_key", "column_name"))
    return reduce(DataFrame.unionByName, parts)


@query("markup_clean", f"""
select page_id, {sql_strip('''regexp_replace(replace(
  regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', chr(160)), '&copy;', chr(169)), '&middot;', chr(183)),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&amp;?', '&', 'g'),
  chr(13) || chr(10), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')''')} as text from pages""")
def markup_clean(spark, sf):
    return texts(spark, sf, "pages").select("page_id", T.clean_page(F.col("html")).alias("text"))


CAP = 2000
MARKER = "\n\n[cut here]"


@query("capped_text", f"""
select doc_id, case when length(text) <= {CAP} then text else
  rtrim(regexp_replace(text[1:{CAP}], '\\n[^\\n]*\\z', ''), {"' ' || chr(9) || chr(10) || chr(13)"})
  || chr(10) || chr(10) || '[cut here]' end as capped from documents""")
def capped_text(spark, sf):
    return texts(spark, sf, "documents").select(
        "doc_id", T.cap_at_line(F.col("text"), CAP, MARKER).alias("capped"))


HOST_IN_URL = r"^https?://([^/:?#]*)"


@query("grammar_check", """
select page_id, regexp_matches(host, '^[a-z0-9][a-z0-9.-]{1,62}$') as host_ok,
  regexp_matches(url, '^https?://[a-z0-9.-]+(/[a-z0-9/]*)?(\\?[^#]*)?(#.*)?$') as url_ok,
  regexp_matches(sha256(url), '^[0-9a-f]{64}$') as digest_ok
from (select *, regexp_extract(url, '^https?://([^/:?#]*)', 1) as host from pages)""")
def grammar_check(spark, sf):
    host = F.regexp_extract("url", HOST_IN_URL, 1)
    return texts(spark, sf, "pages").select(
        "page_id", host.rlike(r"^[a-z0-9][a-z0-9.-]{1,62}$").alias("host_ok"),
        F.col("url").rlike(r"^https?://[a-z0-9.-]+(/[a-z0-9/]*)?(\?[^#]*)?(#.*)?$").alias("url_ok"),
        F.sha2("url", 256).rlike(r"^[0-9a-f]{64}$").alias("digest_ok"))


@query("name_norm", """
select c_custkey, lower(c_name) as plain, lower(replace(c_name, '#', ' ')) as decorated from customer""")
def name_norm(spark, sf):
    noisy = F.concat(F.lit("  "), F.regexp_replace("c_name", "#", "   "), F.lit(" ( QA) "))
    return table(spark, sf, "customer").select(
        "c_custkey", T.normal_name(F.col("c_name")).alias("plain"), T.normal_name(noisy).alias("decorated"))


# Ordered (needles, mode, archetype) rules; the first whose needles are all in the title wins.
TITLE_RULES = [
    (["economy", "ring"], "man", "economy-ring"), (["economy"], "pkg", "economy"),
    (["promo"], "svc", "promo"), (["standard", "red"], "cfg", "standard-red"), (["small"], "file", "small"),
]


def _sql_title(i: int) -> str:
    cases = " ".join("when " + " and ".join(f"contains(t, '{n}')" for n in r[0]) + f" then '{r[i]}'"
                     for r in TITLE_RULES)
    return f"case {cases} else '{'cfg' if i == 1 else 'generic'}' end"


@query("title_archetype", f"""
select p_partkey, {_sql_title(1)} as mode, {_sql_title(2)} as archetype
from (select p_partkey, lower(p_type || ' ' || p_name) as t from part)""")
def title_archetype(spark, sf):
    t = F.lower(F.concat_ws(" ", "p_type", "p_name"))
    out = []
    for i, default in ((1, "cfg"), (2, "generic")):
        expr = F.when(F.lit(False), "")
        for needles, *values in TITLE_RULES:
            cond = F.lit(True)
            for n in needles:
                cond = cond & t.contains(n)
            expr = expr.when(cond, values[i - 1])
        out.append(expr.otherwise(default))
    return table(spark, sf, "part").select("p_partkey", out[0].alias("mode"), out[1].alias("archetype"))


@query("content_ids", "select doc_id, 'ref-' || substr(sha256(text), 1, 16) as id from documents")
def content_ids(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", H.content_id(F.col("text")).alias("id"))


@query("eligible_rows", """
select d.doc_id, governing, verbatim, not truncated as whole, governing and verbatim and not truncated as eligible
from (select doc_id, starts_with(source, 'src1') as governing, n_chars = length(text) as verbatim,
        regexp_matches(text, '[-=,]\\s*\\z') or (length(text) - length(replace(text, '"', ''))) % 2 = 1 as truncated
      from documents) d join labels l on d.doc_id = l.doc_id where l.quality = 1""")
def eligible_rows(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    cut = F.col("text").rlike(r"[-=,]\s*\z") | (F.regexp_count("text", F.lit('"')) % 2 == 1)
    d = table(spark, sf, "documents").join(good, "doc_id").select(
        "doc_id", F.col("source").startswith("src1").alias("governing"),
        (F.col("n_chars") == F.length("text")).alias("verbatim"), (~cut).alias("whole"))
    return d.withColumn("eligible", F.col("governing") & F.col("verbatim") & F.col("whole"))


@query("guide_titles", """
select distinct p_name, case when p_name = '' then '' else
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') end as title
from part""")
def guide_titles(spark, sf):
    return table(spark, sf, "part").select("p_name").distinct().select(
        "p_name", T.title_case(F.col("p_name")).alias("title"))
