"""Queries that drive the readers and miners over text built from the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.operators import mining as M
from spanledger.operators.lines import staged_candidates
from spanledger.operators.support import Shelf, computed
from spanledger.plans.base import query, table, texts
from spanledger.sources import captures as K
from spanledger.sources import manifests as A
from spanledger.sources import rules_xml as X
from spanledger.sources import text as R


@query("pinned_files")
def pinned_files(spark, sf):
    """Every table file against pins that leave one out, alter one and invent one."""
    found = A.file_digests(spark, sf, "*.parquet")
    altered = F.when(F.col("file") == "part.parquet", F.reverse("sha256")).otherwise(F.col("sha256"))
    pins = found.where("file <> 'region.parquet'").select("file", altered.alias("sha256"))
    invented = found.where("file = 'region.parquet'").select(F.lit("regions.parquet").alias("file"), "sha256")
    return A.verify_pins(found, pins.unionByName(invented))


@query("pinned_texts", """
select coalesce(f.file, p.file) as file, case when f.file is null then 'missing' when p.file is null then 'unpinned'
  when f.sha256 <> p.sha256 then 'mismatch' else 'ok' end as status
from (select 'doc-' || doc_id as file, sha256(text) as sha256 from documents) f full join (
  select case when doc_id % 50 = 3 then 'gone-' || doc_id else 'doc-' || doc_id end as file,
    sha256(case when doc_id % 50 = 1 then text || '.' else text end) as sha256 from documents where doc_id % 50 <> 2) p on f.file = p.file""")
def pinned_texts(spark, sf):
    """Texts against a table of pins: a file of JSON lines that was written apart and is read as an input."""
    docs = texts(spark, sf, "documents")
    pinned = F.when(F.col("doc_id") % 50 == 1, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    name = F.when(F.col("doc_id") % 50 == 3, F.concat(F.lit("gone-"), "doc_id")).otherwise(F.concat(F.lit("doc-"), "doc_id"))
    path = f"{Shelf(spark).root}/pins"
    docs.where("doc_id % 50 <> 2").select(name.alias("file"), F.sha2(pinned, 256).alias("sha256")).write.json(path)
    found = docs.select(F.concat(F.lit("doc-"), "doc_id").alias("file"), F.sha2("text", 256).alias("sha256"))
    return A.verify_pins(found, spark.read.schema("file string, sha256 string").json(path))


_CITED = {"documents": ("doc_id", ["text", "lang", "source"]), "orders": ("o_orderkey", ["o_orderstatus", "o_orderpriority"]),
          "pages": ("page_id", ["url", "html"]), "conversations": ("conv_id", ["role", "text"]), "benchmark": ("item_id", ["text"])}


def _text_bytes(columns, size) -> str:
    return " + ".join(f"coalesce({size}({c}), 0)" for c in columns)


@query("provenance_manifest", " union all ".join(
    f"""select '{t}.parquet' as file, count(*) as cited_rows, cast(sum({_text_bytes(columns, 'strlen')}) as bigint) as text_bytes,
  min({key}) as first_key, max({key}) as last_key, (select string_agg(column_name, ',' order by column_name) from (describe {t})) as columns from {t}"""
    for t, (key, columns) in _CITED.items()))
def provenance_manifest(spark, sf):
    """What is cited of each source: rows, bytes of text, range of keys, and the columns that its version has."""
    parts = []
    for t, (key, columns) in _CITED.items():
        d = table(spark, sf, t)
        parts.append(d.agg(F.count("*").alias("cited_rows"), F.sum(F.expr(_text_bytes(columns, "octet_length"))).alias("text_bytes"),
                           F.min(key).alias("first_key"), F.max(key).alias("last_key")).select(
            F.lit(f"{t}.parquet").alias("file"), "*", F.lit(",".join(sorted(d.columns))).alias("columns")))
    return reduce(DataFrame.unionByName, parts)


@query("provenance_digests")
def provenance_digests(spark, sf):
    """(file, sha256, bytes) of the cited sources' files alone, as a release states them."""
    cited = spark.createDataFrame([(f"{t}.parquet",) for t in _CITED], "file string")
    return A.cited_sources(cited, A.file_digests(spark, sf, "*.parquet"))


_XML = """concat('<Group id="V-', p_partkey, '"><Rule id="R-', p_partkey, '" severity="',
 case p_size % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' else 'odd' end, '"><version>',
 case when p_size = 7 then '' else concat('S-', p_partkey) end, '</version><title>', p_name, ' &amp; ', p_type,
 '</title><ident system="http://x/cci">CCI-', p_size, '</ident><ident system="http://x/old">', p_brand,
 '</ident><ident system="http://x/CCI">CCI-', p_size + 1, '</ident><ident system="http://x/cci">CCI-', p_size,
 '</ident><check><check-content>look at ', p_brand, '</check-content></check><fixtext>set ', p_size, '</fixtext></Rule></Group>')"""


def _rules(spark, sf):
    xml = texts(spark, sf, "part").select(F.expr(_XML).alias("xml"))
    return X.rule_rows(X.parse_groups(xml, "xml"))


@query("xml_rows", """
select 'V-' || p_partkey as v, case when p_size = 7 then '' else 'S-' || p_partkey end as i, 'R-' || p_partkey as rid,
  case p_size % 4 when 0 then 'I' when 1 then 'II' when 2 then 'III' else '' end as c, p_name || ' & ' || p_type as t,
  'CCI-' || p_size || ',CCI-' || (p_size + 1) as cci, 'look at ' || p_brand as chk, 'set ' || p_size as fix from part""")
def xml_rows(spark, sf):
    r = _rules(spark, sf)
    return r.withColumns({"cci": F.array_join("cci", ","), "c": F.coalesce("c", F.lit("")), "i": F.coalesce("i", F.lit(""))})


@query("xml_violations", """
select 'V-' || p_partkey as v, 'missing-id' as code from part where p_size = 7
union all select 'V-' || p_partkey, 'unknown-severity' from part where p_size % 4 = 3""")
def xml_violations(spark, sf):
    return X.rule_violations(_rules(spark, sf))


@query("crosswalk_revision", """
with i as (select p_brand as cci, p_type as title, p_size as rev, p_partkey as pos, p_name as idx from part
  where p_type <> 'PROMO' and p_brand in (select p_brand from part join lineitem on l_partkey = p_partkey))
select cci, cast(rev as bigint) as rev, idx as nist from (select *, row_number() over (partition by cci order by rev desc, pos) as rn from i) where rn = 1""")
def crosswalk_revision(spark, sf):
    part = table(spark, sf, "part")
    items = part.select(F.col("p_brand").alias("cci"), F.col("p_type").alias("title"),
                        F.col("p_size").cast("bigint").alias("rev"), F.col("p_partkey").alias("pos"),
                        F.col("p_name").alias("index"))
    sold = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    referenced = part.join(sold, "p_partkey", "left_semi").select(F.col("p_brand").alias("cci")).distinct()
    return X.crosswalk(items, referenced, excluded="PROMO")


@query("release_identity", """
select page_id, case when declared <> '' then declared else named end as identity, case when declared = '' then 'undeclared'
  when named = '' then 'unnamed' when declared <> named then 'mismatch' else 'match' end as status
from (select page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) as declared,
  regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) as named from pages)""")
def release_identity(spark, sf):
    declared = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    named = F.regexp_extract("url", "^https?://[^/]+/([a-z]{2})/", 1)
    return X.release_identity(texts(spark, sf, "pages"), declared, named).select("page_id", "identity", "status")


@query("release_tags", """
select s_suppkey, case when s_nationkey % 5 = 0 then '' else 'V' || s_nationkey || 'R' || (s_suppkey % 9) end as tag from supplier""")
def release_tags(spark, sf):
    info = F.concat(F.lit("Release: "), (F.col("s_suppkey") % 9).cast("string"), F.lit(" Benchmark Date: 24 Jul 2024"))
    version = F.when(F.col("s_nationkey") % 5 == 0, "").otherwise(F.col("s_nationkey").cast("string"))
    return table(spark, sf, "supplier").select("s_suppkey", X.release_tag(version, info).alias("tag"))


@query("jsonl_rows", """
select 'row' as what, 's' || s_suppkey as c, cast(s_nationkey as bigint) as l, s_suppkey % 3 as j from supplier
union all select 'meta', n_name, count(s_suppkey), 0 from nation left join supplier on s_nationkey = n_nationkey group by n_name""")
def jsonl_rows(spark, sf):
    """JSON lines with one manifest line per nation, split back into manifests and rows."""
    sup, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    rows = sup.select(F.to_json(F.struct(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("c"),
                                         F.col("s_nationkey").alias("l"), (F.col("s_suppkey") % 3).alias("j"))).alias("value"))
    counts = (nation.join(sup, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_name")
              .agg(F.count("s_suppkey").alias("n")))
    head = counts.select(F.to_json(F.struct(F.struct(F.col("n_name").alias("name"), F.col("n").alias("candidates"))
                                            .alias("_meta"))).alias("value"))
    meta, data = R.split_manifest(head.unionByName(rows), "value", "name:string,candidates:bigint",
                                  "c string, l bigint, j bigint")
    return data.select(F.lit("row").alias("what"), "c", "l", "j").unionByName(
        meta.select(F.lit("meta").alias("what"), F.col("name").alias("c"), F.col("candidates").alias("l"),
                    F.lit(0).cast("bigint").alias("j")))


@query("json_map_flatten", """
select event_id, 'k' as name, cast(json_extract_string(props, '$.k') as bigint) as value from events""")
def json_map_flatten(spark, sf):
    return R.flatten_map(table(spark, sf, "events"), F.col("props"), "bigint", "event_id")


@query("dictionary_rows", """
select distinct p_partkey, p_brand as tool, unnest(['--' || split_part(p_name, ' ', 1), '-' || p_name[1]]) as name, p_size > 25 as takes_arg from part""")
def dictionary_rows(spark, sf):
    first = F.substring_index("p_name", " ", 1)
    flags = F.array(F.struct(F.array(F.concat(F.lit("--"), first), F.concat(F.lit("-"), F.substring("p_name", 1, 1)))
                             .alias("names"), (F.col("p_size") > 25).alias("takes_arg")))
    text = F.to_json(F.create_map("p_brand", F.struct(F.lit(True).alias("available"), flags.alias("flags"))))
    return R.flatten_dictionary(table(spark, sf, "part").select("p_partkey", text.alias("j")), F.col("j"), "p_partkey")


@query("markdown_table", """
select p_partkey, p_name, p_brand, p_type, cast(p_size as varchar) as p_size from part where p_size <> 13""")
def markdown_table(spark, sf):
    """Each part as a small markdown table: a header, a rule, a row, and a short row on size 13."""
    cells = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in cells]), F.lit(" |"))
    row = F.when(F.col("p_size") == 13, F.concat(F.lit("| "), F.col("p_name"), F.lit(" |"))).otherwise(row)
    body = F.concat_ws("\n", F.lit("intro"), F.lit("| " + " | ".join(cells) + " |"), F.lit("|---|---|"), row)
    lines = table(spark, sf, "part").select(F.explode(F.split(body, "\n")).alias("line"))
    got = R.markdown_rows(lines, "line", 6, ["p_partkey"])
    out = got.select(*[F.col("cells")[i].alias(c) for i, c in enumerate(cells[:5])])
    return out.withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query("capture_ingest", """
with d as (select o_orderkey as k, o_orderkey % 10 as m, cast(7 + o_custkey % 4 as varchar) as rel from orders)
select 'error' as what, k, 'not-json' as code from d where m = 1
union all select 'error', k, 'missing-host' from d where m = 2
union all select 'error', k, 'hash-mismatch' from d where m = 3
union all select 'error', k, 'release-differs-from-path' from d where m = 4
union all select 'error', k, 'entry-differs-from-name' from d where m = 5
union all select 'error', k, 'duplicate-key' from d where m = 6
union all select 'valid', k, 'e-' || k from d where m in (0, 6, 7, 8, 9)""")
def capture_ingest(spark, sf):
    """Orders as capture files with one planted defect per last digit of the key; 6 comes twice."""
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 10
    rel, entry = (F.col("o_custkey") % 4 + 7).cast("string"), F.concat(F.lit("e-"), k.cast("string"))
    run = F.col("o_orderpriority")
    plain = F.lit("x")
    fields = {
        "entry_id": entry, "rhel_version": rel, "host": F.when(m != 2, F.lit("host")), "redhat_release": plain,
        "kernel": plain, "pkg_versions": F.create_map(F.lit("a"), F.lit("1")), "command_as_run": run,
        "exit_code": F.lit(0), "stdout": plain, "stderr": plain, "captured_on": plain, "captured_by": plain,
        "blast_confirmed": plain, "undo_executed": F.struct(F.lit(False).alias("run"), F.lit("none").alias("reason")),
        "command_hash_at_capture": F.sha2(F.when(m == 3, F.lit("else")).otherwise(run), 256), "verify_result": plain}
    body = F.to_json(F.named_struct(*[x for n, c in fields.items() for x in (F.lit(n), c)]))
    body = F.when(m == 1, F.concat(F.lit("{broken"), body)).otherwise(body)
    folder = F.when(m == 4, F.lit("6")).otherwise(rel)
    name = F.when(m == 5, F.concat(F.lit("x-"), k.cast("string"))).otherwise(entry)
    copies = F.when(m == 6, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    path = F.concat_ws("/", F.col("top"), folder, F.concat(name, F.lit(".json")))
    files = computed(texts(spark, sf, "orders").withColumn("top", F.explode(copies)),
                     {"path": path, "body": body}).select("path", "body")
    good, errors = K.index_captures(files)
    number = F.regexp_extract("path", r"-([0-9]+)\.json$", 1).cast("bigint")
    return errors.select(F.lit("error").alias("what"), number.alias("k"), "code").unionByName(
        good.select(F.lit("valid").alias("what"), number.alias("k"), F.col("entry_id").alias("code")))


# A manual page per part. Sizes decide what its option list holds.
_MAN = """concat('NAME', chr(10), '  tool', p_partkey, ' - ', p_name, chr(10), chr(10), 'SYNOPSIS', chr(10), '  tool', p_partkey,
 ' [options] ', p_type, chr(10), '  other --run', chr(10), chr(10), case when p_size % 5 = 0 then 'DESCRIPTION' else 'OPTIONS' end, chr(10),
 case p_size % 5 when 0 then concat('  The -z', p_size, ' switch and --deep apply.', chr(10))
  else concat(chr(10), '  -a, --all', p_size, '=LEVEL', chr(10), '      Sets the level.', chr(10), chr(10),
   '  --quick', p_size, chr(10), '      Runs fast.', chr(10), chr(10), '  See the manual for more.', chr(10), chr(10),
   '  Added in version 3.', chr(10), chr(10), '  [--zone]', chr(10), '  -n NUMBER', chr(10), '      Count.', chr(10)) end,
 chr(10), 'EXAMPLES', chr(10), '  tool', p_partkey, ' -a ', p_size, chr(10), '  This shows it.', chr(10))"""


def manuals(spark, sf):
    body = F.expr(_MAN.replace("chr(10)", "decode(unhex('0A'), 'UTF-8')"))
    return texts(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("tool"), F.col("p_partkey").cast("string")).alias("own"), body.alias("text"))


@query("definition_list", """
select p_partkey, 'term' as kind, names, takes_arg from (
  select p_partkey, unnest(['-a,--all' || p_size, '--quick' || p_size, '-n']) as names, unnest([true, false, true]) as takes_arg
  from part where p_size % 5 <> 0)
union all select p_partkey, 'hint', '--deep, -z' || p_size, false from part where p_size % 5 = 0""")
def definition_list(spark, sf):
    return M.definition_list(manuals(spark, sf), "p_partkey", "text").select("p_partkey", "kind", "names", "takes_arg")


@query("section_commands", """
select p_partkey, 'SYNOPSIS' as section, 'tool' || p_partkey || ' [options] ' || p_type as command, true as taken from part
union all select p_partkey, 'SYNOPSIS', 'other --run', false from part
union all select p_partkey, 'EXAMPLES', 'tool' || p_partkey || ' -a ' || p_size, true from part
union all select p_partkey, 'EXAMPLES', 'This shows it.', false from part""")
def section_commands(spark, sf):
    return M.section_commands(manuals(spark, sf), "p_partkey", "text", "own").select(
        "p_partkey", "section", "command", "taken")


_HELP = """concat('Usage: tool', p_partkey, ' [options]', chr(10), '  -H --host=[USER@]HOST    Connect to ', p_name, chr(10),
 '                          over ssh', chr(10), '  -q, --quiet', p_size, '  Say nothing', chr(10), '  -q, --quiet', p_size, '  Again', chr(10),
 '  --level N', chr(10), '      How much', chr(10), '  --', chr(10))"""


def help_pages(spark, sf):
    body = F.expr(_HELP.replace("chr(10)", "decode(unhex('0A'), 'UTF-8')"))
    return texts(spark, sf, "part").select("p_partkey", body.alias("text"))


@query("help_options", """
select p_partkey, unnest(['option', 'option', 'option', 'unparsed', 'unparsed']) as kind,
  unnest(['-H,--host', '-q,--quiet' || p_size, '--level', '--', '--']) as names,
  unnest([cast(2 as bigint), 4, 6, 8, 10]) as line_no, unnest([true, false, true, false, false]) as takes_arg from part""")
def help_options(spark, sf):
    """Behind the page come an unparsed line deep in a description and an unparsed line that was there before."""
    pages = help_pages(spark, sf).withColumn("text", F.concat("text", F.lit("        --\n  --\n")))
    return M.help_options(pages, "p_partkey", "text").select(
        "p_partkey", "kind", "names", "line_no", "takes_arg")


@query("continued_descriptions", """
select p_partkey, unnest([cast(1 as bigint), 2, 3, 4, 5]) as option_no,
  unnest(['-H --host=[USER@]HOST', '-q, --quiet' || p_size, '-q, --quiet' || p_size, '--level N', '--']) as option,
  unnest(['Connect to ' || p_name || ' over ssh', 'Say nothing', 'Again', 'How much', '']) as description from part""")
def continued_descriptions(spark, sf):
    return M.described_options(help_pages(spark, sf), "p_partkey", "text").select(
        "p_partkey", "option_no", "option", "description")


# A small shell session per part: joined lines, a blank that ends a join, a plain line, and
# a join longer than the limit on some.
_SESSION = """concat('intro', NL, '$ tool ', p_name, ' ', BS, NL, '    --size ', p_size, ' ', BS, ' ', NL, '  -v', NL, 'plain ', BS, NL,
 '# next ', p_brand, BS, NL, NL, '  $ last ', p_partkey, NL, case when p_size % 10 = 0 then
 concat('# long', repeat(concat(' ', BS, NL, '  x'), 10), NL) else '' end)"""


@query("joined_lines", """
select p_partkey, unnest([cast(2 as bigint), 6, 8]) as line_no, unnest(['$', '#', '$']) as prompt,
  unnest(['tool ' || p_name || ' --size ' || p_size || ' -v', 'next ' || p_brand || chr(92), 'last ' || p_partkey]) as command,
  unnest([cast(2 as bigint), 1, 0]) as joined from part
union all select p_partkey, 9, '#', 'long x x x x x x x x ' || chr(92), 8 from part where p_size % 10 = 0""")
def joined_lines(spark, sf):
    body = _SESSION.replace("NL", "decode(unhex('0A'), 'UTF-8')").replace("BS", "decode(unhex('5C'), 'UTF-8')")
    files = computed(texts(spark, sf, "part"), {"body": F.expr(body)})
    return staged_candidates(files, "p_partkey", "body")
