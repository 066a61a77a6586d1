"""Queries over order: runs, fills, samples, bands, postings, search, census."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanledger.functions import hashing as H
from spanledger.functions import text as T
from spanledger.functions import words as W
from spanledger.operators import census as N
from spanledger.operators import integrity as I
from spanledger.operators import joins as J
from spanledger.operators import patterns as P
from spanledger.operators import search as S
from spanledger.operators import windows as X
from spanledger.operators.lines import explode_lines, with_prompt
from spanledger.operators.index_store import StoredIndex
from spanledger.operators.support import Shelf, dealt, settled
from spanledger.plans.base import (DOC_LINES, LOG, LOG_COMMANDS, TEXT_KEYS, command_log, document_lines, query, table,
                                   texts)

MICROS = "timestampdiff(MICROSECOND, timestamp '1970-01-01 00:00:00', ts)"
HOUR = 3_600_000_000


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("us", F.expr(MICROS))


@query("run_islands", """
with d as (select user_id, event_id, ts, event_type, row_number() over w as rk,
    case when lag(event_type) over w is not distinct from event_type then 0 else 1 end as st
  from events window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(st) over (partition by user_id order by rk) as run_no from d),
p as (select *, (rk - min(rk) over (partition by user_id, run_no)) // 9 + 1 as piece_no from r)
select user_id, cast(run_no as bigint) as run_no, cast(piece_no as bigint) as piece_no, min(event_type) as event_type,
  count(*) as n, string_agg(cast(event_id as varchar), ' ' order by rk) as joined from p group by user_id, run_no, piece_no""")
def run_islands(spark, sf):
    d = _events(spark, sf).select("user_id", "event_id", "us", "event_type")
    pieces = X.runs(d, ["user_id"], ["us", "event_id"], "event_type", F.floor(F.col("us") / (24 * HOUR)))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id"))), lambda x: x["event_id"].cast("string"))
    return pieces.groupBy("user_id", "run_no", "piece_no").agg(
        F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.array_join(ids, " ").alias("joined"))


@query("forward_fill", f"""
select doc_id, line_no, coalesce(last_value(h ignore nulls) over (partition by doc_id order by line_no
  rows between unbounded preceding and current row), '') as section
from (select doc_id, line_no, case when regexp_matches(line, '^[^.]+$') then line end as h from ({DOC_LINES}))""")
def forward_fill(spark, sf):
    heading = F.when(F.col("line").rlike(r"^[^.]+$"), F.col("line"))
    d = X.forward_fill(document_lines(spark, sf), ["doc_id"], "line_no", heading, "section")
    return d.select("doc_id", "line_no", F.coalesce("section", F.lit("")).alias("section"))


@query("stride_sample", """
with r as (select source, doc_id, row_number() over (partition by source order by doc_id) as rn,
  count(*) over (partition by source) as n from documents)
select source, doc_id from r where n <= 20 or ((rn - 1) % 7 = 0 and (rn - 1) // 7 < 20)""")
def stride_sample(spark, sf):
    return X.stride_sample(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id").select(
        "source", "doc_id")


@query("cap_per_group", """
select l_suppkey, l_orderkey, l_partkey, l_linenumber, position from (
  select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_partkey, l_linenumber,
    l_quantity, l_shipdate) as position from lineitem where l_returnflag = 'R') where position <= 18""")
def cap_per_group(spark, sf):
    d = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate"]
    return X.first_per_group(d, ["l_suppkey"], order, 18).select(
        "l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", F.col("position").cast("bigint").alias("position"))


@query("band_join", f"""
with e as (select user_id, epoch_us(ts) as us, event_type from events),
a as (select distinct user_id, us from e where event_type = 'error')
select a.user_id, a.us, count(*) as n_near, count(*) filter (where event_type = 'purchase') > 0 as has_purchase
from a join e on e.user_id = a.user_id and e.us between a.us - {3 * HOUR} and a.us + {4 * HOUR} group by a.user_id, a.us""")
def band_join(spark, sf):
    e = _events(spark, sf).select("user_id", "us", "event_type")
    anchors = e.where("event_type = 'error'").select("user_id", "us").distinct()
    out = X.window_counts(anchors, e, ["user_id"], "us", 3 * HOUR, 4 * HOUR, 24 * HOUR, {
        "n_near": F.lit(1), "n_buy": (F.col("event_type") == "purchase").cast("int")})
    return out.select("user_id", "us", "n_near", (F.col("n_buy") > 0).alias("has_purchase"))


@query("mode_per_group", f"""
select doc_id, cast(len as bigint) as len, n from (select doc_id, length(line) as len, count(*) as n,
  row_number() over (partition by doc_id order by count(*) desc, length(line)) as rn from ({DOC_LINES}) group by doc_id, length(line))
where rn = 1""")
def mode_per_group(spark, sf):
    d = document_lines(spark, sf).select("doc_id", F.length("line").cast("bigint").alias("len"))
    return N.mode_per_group(d, "doc_id", "len")


# ---- index and search ---------------------------------------------------------------------

@query("search_frame", """
select 'document' as kind, 'd' || doc_id as id, source as label, sha256(lower(text || ' ' || source || ' ' || lang)) as hay from documents
union all select 'part', 'p' || p_partkey, p_name, sha256(lower(p_name || ' ' || p_brand || ' ' || p_type)) from part
union all select 'supplier', 's' || s_suppkey, s_name, sha256(lower(s_name)) from supplier
union all select 'customer', 'c' || c_custkey, c_name, sha256(lower(c_name || ' ' || c_mktsegment)) from customer""")
def search_frame_q(spark, sf):
    return search_frame(spark, sf).withColumn("hay", F.sha2("hay", 256))


def search_frame(spark, sf):
    def part_of(df, kind, key, label, *cols):
        return df.select(F.lit(kind).alias("kind"), F.concat(F.lit(kind[0]), F.col(key).cast("string")).alias("id"),
                         F.col(label).alias("label"), S.haystack(*[F.col(c) for c in cols]).alias("hay"))
    return (part_of(texts(spark, sf, "documents"), "document", "doc_id", "source", "text", "source", "lang")
            .unionByName(part_of(table(spark, sf, "part"), "part", "p_partkey", "p_name", "p_name", "p_brand", "p_type"))
            .unionByName(part_of(table(spark, sf, "supplier"), "supplier", "s_suppkey", "s_name", "s_name"))
            .unionByName(part_of(table(spark, sf, "customer"), "customer", "c_custkey", "c_name", "c_name", "c_mktsegment")))


SEARCHES = ["the", "red widget", "src1 licensed", "supplier#0000000", "under cc", "build", "zzzz_no_such_thing"]

_FRAME = """
select 'document' as kind, 'd' || doc_id as id, source as label, lower(text || ' ' || source || ' ' || lang) as hay from documents
union all select 'part', 'p' || p_partkey, p_name, lower(p_name || ' ' || p_brand || ' ' || p_type) from part
union all select 'supplier', 's' || s_suppkey, s_name, lower(s_name) from supplier
union all select 'customer', 'c' || c_custkey, c_name, lower(c_name || ' ' || c_mktsegment) from customer"""


def _sql_score(q: str) -> str:
    return " + ".join(f"case when regexp_matches(hay, '(?:^|[^a-z0-9]){t.replace('#', '[#]')}') then 3 "
                      f"when contains(hay, '{t}') then 1 end" for t in q.split())


_SCORED = " union all ".join(
    f"select '{q}' as query, kind, id, label, {_sql_score(q)} as score from f" for q in SEARCHES)


@query("ranked_search", f"""
with f as ({_FRAME}), s as (select * from ({_SCORED}) where score is not null),
b as (select *, row_number() over (partition by query, kind order by score desc, id) as position from s)
select query, kind, id, label, cast(score as bigint) as score, position from b where position <= 8
union all select q, 'no-match', '', '', 0, 0 from (select unnest([{", ".join(f"'{q}'" for q in SEARCHES)}]) as q)
  where q not in (select query from s)""")
def ranked_search(spark, sf):
    out = S.ranked_search(search_frame(spark, sf), SEARCHES)
    return out.withColumns({"score": F.col("score").cast("bigint"), "position": F.col("position").cast("bigint")})


@query("index_search", f"""
with f as ({_FRAME}) """ + " union all ".join(
    f"select '{q}' as query, kind, id from f where " + " and ".join(f"contains(hay, '{t}')" for t in q.split())
    for q in SEARCHES))
def index_search(spark, sf):
    """Written once; the search opens only families and buckets that hold a term."""
    frame = search_frame(spark, sf)
    return StoredIndex.write(frame, f"{Shelf(spark).root}/index").search(frame, SEARCHES)


_POSTINGS = """
select distinct doc_id, token from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_.+-]+')) as token
  from documents) where length(token) >= 2"""


def _postings(spark, sf):
    return S.postings(texts(spark, sf, "documents").select("doc_id", F.lower("text").alias("hay")), "doc_id", "hay")


@query("inverted_index", f"""
select token, doc_id // 4096 as block_no, string_agg(cast(doc_id as varchar), ',' order by doc_id) as postings, count(*) as n
from ({_POSTINGS}) group by token, doc_id // 4096""")
def inverted_index(spark, sf):
    return S.posting_blocks(_postings(spark, sf), "doc_id").withColumn("postings", F.array_join("postings", ","))


@query("posting_deltas", f"""
select token, doc_id, doc_id - coalesce(lag(doc_id) over (partition by token order by doc_id), 0) as delta, doc_id as decoded
from ({_POSTINGS})""")
def posting_deltas(spark, sf):
    """Texts are dealt by block of ids, so that a block's postings become sorted lists where they are cut; then lists move."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("hay"))
    whole = dealt(docs.where("doc_id is not null").withColumn("block_no", F.expr(f"doc_id div {S.BLOCK}")), "block_no")
    flat = S.postings(whole, "doc_id", "hay", "block_no")
    # The blocks are a table that is stored once; its lists are shuffled once, for coding and decoding.
    blocks = settled(flat.groupBy("token", "block_no").agg(F.array_sort(F.collect_set("doc_id")).alias("postings")))
    # A document without an id has no place in a list.
    none = S.postings(docs.where("doc_id is null"), "doc_id", "hay").select("token").distinct()
    null = F.lit(None).cast("long")
    return S.decoded_blocks(S.coded_blocks(blocks), "doc_id").unionByName(
        none.select("token", null.alias("doc_id"), null.alias("delta"), null.alias("decoded")))


# ---- command lines ------------------------------------------------------------------------

def log_commands(spark, sf):
    d = with_prompt(command_log(spark, sf)).where(F.col("prompt") != "")
    return d.select("event_id", "user_id", "release", "prompt", "command")


COMMANDS = f"select * from ({LOG_COMMANDS}) where prompt <> ''"
# The log's quoted runs and substitutions, blanked step by step.
_QUIET = (r"""regexp_replace(regexp_replace(regexp_replace(command, '"[^"]*"', '_', 'g'), '''[^'']*''', '_', 'g'), '\$\([^()]*\)', '_', 'g')""")
_OPS = rf"regexp_extract_all({_QUIET}, '2>&1|&&|\|\||2>|>>|\||;|>')"


@query("operator_census", f"select operator, count(*) as n from (select unnest({_OPS}) as operator from ({COMMANDS})) group by operator")
def operator_census(spark, sf):
    return N.operator_census(log_commands(spark, sf), "command")


@query("shape_census", f"""
select array_to_string(ops, ' ') as shape, count(*) as n, count(*) filter (where not contains(command, '$(')
  and not regexp_matches(command, '\\bfor\\b.*\\bdo\\b') and len(list_filter(ops, lambda o: o not in ('|', '&&', '||', ';'))) = 0) as expressible
from (select command, {_OPS} as ops from ({COMMANDS})) group by 1""")
def shape_census(spark, sf):
    d = log_commands(spark, sf).withColumn("ok", N.expressible(F.col("command"), ["|", "&&", "||", ";"]))
    d = d.select(F.array_join(N.top_level_operators(F.col("command")), " ").alias("shape"), "ok")
    return d.groupBy("shape").agg(F.count("*").alias("n"), F.count_if("ok").alias("expressible"))


_PEEL = r"""regexp_replace(regexp_replace(regexp_replace(st, '^(sudo -u [^ ]+|nohup|timeout [0-9]+|xargs -n 1) ', ''),
  '^[A-Za-z_][A-Za-z0-9_]*=[^ ]* ', ''), '^(sudo -u [^ ]+|nohup) ', '')"""
_STAGES = rf"""select event_id, command, trim(unnest(string_split_regex(regexp_replace(regexp_replace(command, '"[^"]*"', '"Q"', 'g'),
  '\$\([^()]*\)', 'SUB', 'g'), '\|\||&&|\||;'))) as st from ({COMMANDS})"""


@query("head_census", f"""
select head, count(*) as n from (select regexp_extract(split_part({_PEEL}, ' ', 1), '([^/]*)$', 1) as head
  from ({_STAGES}) where st <> '') where head <> '' group by head""")
def head_census(spark, sf):
    return N.head_census(log_commands(spark, sf), "command")


_PATTERN = "greatest(" + ", ".join(
    f"case when contains(lower(t), '{m.lower()}') or contains(replace(replace(lower(t), '\"', ''), '''', ''), '{m.lower()}') "
    f"then {P.RANK[r]} else -1 end" for _, m, r in P.DESTRUCTIVE) + ")"


@query("pattern_rating", f"""
select family, rating, count(*) as n from (select family, case {_PATTERN} when 2 then 'red' when 1 then 'yellow' else 'unrated' end as rating
from (select 'log' as family, line as t from ({LOG}) union all select 'documents', line from ({DOC_LINES}))) group by all""")
def pattern_rating(spark, sf):
    d = (command_log(spark, sf).select(F.lit("log").alias("family"), "line")
         .unionByName(document_lines(spark, sf).select(F.lit("documents").alias("family"), "line")))
    return P.rate_by_pattern(d, "line").groupBy("family", "rating").agg(F.count("*").alias("n"))


SIGNATURES = [("sig-script", "<script[^>]*>"), ("sig-nav", "<nav><ul>"), ("sig-query", r"href=.[^ ]*\?page=[0-9]+"),
              ("sig-junk", r"[#$%&*]{3}"), ("sig-charset", "charset=.utf-8")]
_SIG_ORDER = [SIGNATURES[i] for i in (2, 3, 1, 0, 4)]


@query("signature_match", "select page_id, case " + " ".join(
    f"when regexp_matches(html, '(?i){p}') then '{s}'" for s, p in _SIG_ORDER) + " else '' end as signature from pages")
def signature_match(spark, sf):
    return texts(spark, sf, "pages").select("page_id", P.first_signature(F.col("html"), _SIG_ORDER).alias("signature"))


RATINGS = {"cat": "green", "grep": "green", "ls": "green", "df": "green", "true": "green", "find": "green",
           "dnf": "yellow", "systemctl": "yellow", "rsync": "yellow", "tar": "yellow", "useradd": "yellow",
           "rm": "yellow", "echo": "green", "podman": "yellow"}


@query("command_risk", """
select event_id, case k % 20 when 0 then 'yellow' when 1 then 'yellow' when 2 then 'green' when 3 then 'yellow' when 5 then 'red'
  when 6 then 'red' when 12 then 'red' when 14 then 'green' when 16 then 'yellow' when 17 then 'yellow' else 'unrated' end as risk
from (select event_id, cast(json_extract_string(props, '$.k') as int) as k from events) where k % 20 not in (4, 7, 8, 10, 18, 19)""")
def command_risk(spark, sf):
    """The twin states the rating of each kind of log line as read off by hand."""
    return P.command_risk(log_commands(spark, sf), "command", RATINGS).select("event_id", "risk")


@query("state_change_floor", """
select event_id from (select event_id, cast(json_extract_string(props, '$.k') as int) as k from events) where k % 20 = 1""")
def state_change_floor(spark, sf):
    d = log_commands(spark, sf).withColumn("declared", F.when(
        F.col("command").startswith("systemctl"), "green").otherwise("yellow"))
    return P.below_floor(d, "command", "declared").select("event_id")


@query("resolves_any", f"""
with c as (select distinct release, split_part(regexp_replace(command, '^(sudo -u [^ ]+|timeout [0-9]+) ', ''), ' ', 1) as tool,
    unnest(string_split(command, ' ')) as name from ({COMMANDS})),
cl as (select distinct release, tool, name from c where regexp_matches(name, '^(--?[a-z]|/[a-z])')),
dict as (select distinct tool, name from cl where release = '8' and name like '--%')
select cl.release, cl.tool, cl.name, case when d.name is not null then 'dictionary' when cl.name in ('-l', '-u') then 'curated'
  when cl.name like '/%' and cl.release <> '7' then 'marked' else 'unresolved' end as resolution
from cl left join dict d on d.tool = cl.tool and d.name = cl.name""")
def resolves_any(spark, sf):
    bare = F.regexp_replace("command", "^(sudo -u [^ ]+|timeout [0-9]+) ", "")
    c = log_commands(spark, sf).select("release", F.substring_index(bare, " ", 1).alias("tool"),
                                       F.explode(F.split("command", " ")).alias("name"))
    claims = c.where(F.col("name").rlike("^(--?[a-z]|/[a-z])")).distinct().withColumn(
        "license_class", F.when(F.col("release") != "7", "verbatim-ok"))
    dictionary = claims.where((F.col("release") == "8") & F.col("name").startswith("--")).select("tool", "name")
    curated = claims.where(F.col("name").isin("-l", "-u")).select("tool", "name")
    return J.resolves_any(claims, dictionary, curated, ["tool", "name"]).drop("license_class")


@query("constants_agree", """
with a as (select unnest(['a', 'an', 'for', 'the', 'with', 'rsync', 'ls']) as w), b as (select unnest(['a', 'an', 'for', 'the', 'who', 'rsync']) as w),
t as (select distinct split_part(command, ' ', 1) as w from (""" + COMMANDS + """))
select w, 'only-first' as finding from a anti join b using (w) union all select w, 'only-second' from b anti join a using (w)
union all select w, 'names-a-real-tool' from a semi join t using (w)""")
def constants_agree(spark, sf):
    mine = spark.createDataFrame([(w,) for w in ("a", "an", "for", "the", "with", "rsync", "ls")], "w string")
    other = spark.createDataFrame([(w,) for w in ("a", "an", "for", "the", "who", "rsync")], "w string")
    tools = log_commands(spark, sf).select(F.substring_index("command", " ", 1).alias("w")).distinct()
    d = I.missing_stale(mine, other, "w").select(F.col("key").alias("w"), F.when(
        F.col("side") == "stale", "only-first").otherwise("only-second").alias("finding"))
    clash = tools.join(mine, "w", "left_semi").select("w", F.lit("names-a-real-tool").alias("finding"))
    return d.unionByName(clash)


# ---- fingerprints -------------------------------------------------------------------------

_COLS = {
    "benchmark": {"item_id": "i", "text": "s"},
    "conversations": {"conv_id": "i", "role": "s", "text": "s", "turn": "i"},
    "customer": {"c_acctbal": "f", "c_custkey": "i", "c_mktsegment": "s", "c_name": "s", "c_nationkey": "i"},
    "documents": {"doc_id": "i", "lang": "s", "n_chars": "i", "source": "s", "text": "s"},
    "events": {"event_id": "i", "event_type": "s", "props": "s", "ts": "t", "user_id": "i", "value": "f"},
    "labels": {"doc_id": "i", "quality": "i", "toxic": "i"},
    "lineitem": {"l_discount": "f", "l_extendedprice": "f", "l_linenumber": "i", "l_linestatus": "s", "l_orderkey": "i",
                 "l_partkey": "i", "l_quantity": "f", "l_returnflag": "s", "l_shipdate": "t", "l_suppkey": "i", "l_tax": "f"},
    "nation": {"n_name": "s", "n_nationkey": "i", "n_regionkey": "i"},
    "orders": {"o_custkey": "i", "o_orderdate": "t", "o_orderkey": "i", "o_orderpriority": "s", "o_orderstatus": "s", "o_totalprice": "f"},
    "pages": {"html": "s", "page_id": "i", "url": "s"},
    "part": {"p_brand": "s", "p_name": "s", "p_partkey": "i", "p_retailprice": "f", "p_size": "i", "p_type": "s"},
    "region": {"r_name": "s", "r_regionkey": "i"},
    "supplier": {"s_acctbal": "f", "s_name": "s", "s_nationkey": "i", "s_suppkey": "i"},
}


def _sql_fingerprint(tbl: str) -> str:
    plain = {"i": "cast({0} as varchar)", "s": "{0}", "f": "cast({0} as varchar)", "t": "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"}
    row = " || ".join(f"'{c}=' || coalesce(length({v}) || ':' || {v}, '-')" for c, v in (
        (c, plain[k].format(c)) for c, k in sorted(_COLS[tbl].items())))
    sums = ", ".join(f"sum(cast('0x' || substr(d, {1 + 15 * i}, 15) as hugeint)) as h{i}" for i in range(4))
    parts = " || '|' || ".join(f"coalesce(cast(h{i} as varchar), '0')" for i in range(4))
    return (f"select '{tbl}' as tbl, n as n_rows, sha256(cast(n as varchar) || '|' || {parts}) as digest from "
            f"(select count(*) as n, {sums} from (select sha256({row}) as d from {tbl}))")


_FINGERPRINTS = " union all ".join(_sql_fingerprint(t) for t in sorted(_COLS))


@query("table_fingerprint", f"""
with f as ({_FINGERPRINTS}) select * from f union all
select 'all', cast(sum(n_rows) as bigint), sha256(string_agg(digest, chr(10) order by tbl)) from f""")
def table_fingerprint(spark, sf):
    out = None
    for name in sorted(_COLS):
        df = texts(spark, sf, name) if name in TEXT_KEYS else table(spark, sf, name)
        sums = df.select(H.canonical_text(df).alias("_row")).agg(*H.digest_sums(F.col("_row")))
        one = sums.select(F.lit(name).alias("tbl"), F.col("_rows").alias("n_rows"), H.digest_of_sums().alias("digest"))
        out = one if out is None else out.unionByName(one)
    # One row per table by now, so the combined digest lists a handful of digests.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("tbl", "digest"))), lambda x: x["digest"])
    total = out.agg(F.sum("n_rows").alias("n_rows"), F.sha2(F.array_join(ordered, "\n"), 256).alias("digest"))
    return out.unionByName(total.withColumn("tbl", F.lit("all")))
