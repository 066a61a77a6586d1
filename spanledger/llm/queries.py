"""The named queries of this package, each over its whole table, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op4_near_dedup")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    from spanledger.llm.near_dedup import near_duplicates
    return near_duplicates(table(spark, sf, "documents"))


WORDS_SQL = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"
MIX_SQL = f"""
with d as (select doc_id, source, cast({WORDS_SQL} as bigint) as size, md5(cast(doc_id as varchar)) as h from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, 3 * source_size as cap, ([5, 2, 1])[cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as weight,
  cast(sum(source_size) over () as bigint) as budget from s),
r as (select *, cast(cap as double) / weight as ratio from w),
l as (select *, cast(cast(budget as bigint) - coalesce(sum(cap) over (order by ratio, source nulls last
    rows between unbounded preceding and 1 preceding), 0) as double)
  / cast(sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as double) as lv from r),
m as (select (select lv from l where lv <= ratio order by ratio, source nulls last limit 1) as level),
g as (select source, source_size, budget, case when level is null or ratio < level then cast(cap as double)
  else level * weight end as target from l, m),
e as (select d.*, g.source_size, g.budget, g.target,
  sum(size) over (partition by d.source order by h, doc_id, size rows between unbounded preceding and current row) as fin
  from d join g on d.source is not distinct from g.source),
c as (select *, cast(k * source_size + fin as bigint) / target as finish from e, (select unnest([0, 1, 2]) as k) where size > 0 and target > 0),
t as (select doc_id, sum(size) as n from (select *, sum(size) over (order by finish, h, doc_id, k rows between unbounded preceding
  and current row) as upto from c) where upto <= budget group by doc_id)
select e.doc_id, e.size, e.source_size, e.target, cast(coalesce(t.n, 0) as bigint) as taken from e left join t on e.doc_id = t.doc_id
"""


@query("op1_mixing", MIX_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    from spanledger.llm.mixing import queued
    from spanledger.operators.support import Shelf
    return queued(table(spark, sf, "documents"), Shelf(spark)).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_sharding")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    from spanledger.llm.sharding import sharded
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharded(rows, [F.col("doc_id"), F.col("text_crc32")]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op2_token_records")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from spanledger.llm.token_records import record_digests
    return record_digests(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)


LINES_SQL = r"""
with l as (select doc_id, i, ls[i] as line, len(ls) as n from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
o as (select key, max(doc_id) as largest from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
d as (select k.*, o.key is not null and k.doc_id <> o.largest as dropped from k left join o on k.key = o.key)
select doc_id, cast(max(n) as bigint) as n_lines, cast(sum(cast(dropped as int)) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
from d group by doc_id
"""


@query("op5_line_dedup", LINES_SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    from spanledger.llm.line_dedup import dedup_lines
    return dedup_lines(table(spark, sf, "documents"), digest=True)


@query("op3_url_filter")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    from spanledger.llm.url_filter import judged, labelled_by_host
    pages = table(spark, sf, "pages")
    return judged(pages, labelled_by_host(pages))


RULES_SQL = r"""
with a as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, i, list_slice(w, i, i + 7) as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from a where len(w) >= 8)),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from p) where c > 1),
n as (select doc_id, sum(least(8, coalesce(nxt - i, 8))) as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from r) group by doc_id),
b as (select doc_id, t, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from a),
s as (select b.*, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(n.n, 0) as bigint) as n_repeat_words
  from b left join n using (doc_id)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed
  or 10 * n_symbols > 3 * n_words or (n_dup_lines > 3 and 100 * n_dup_lines > 30 * len(string_split(t, chr(10))))
  or word_chars < 2 * n_words or word_chars > 20 * n_words or 2 * len(regexp_extract_all(t, '!!')) > n_words
  or 2 * length(regexp_replace(t, '[^\p{L}]+', '', 'g')) < word_chars) as kept
from f
"""


@query("op8_quality_rules", RULES_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    from spanledger.llm.quality_rules import cascade
    return cascade(table(spark, sf, "documents").select("doc_id", "text")).drop("text")


@query("op7_quality_grade")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Grades: 0 low quality, 1 good but toxic, 2 good."""
    from spanledger.llm.ordinal import graded
    ratings = table(spark, sf, "labels").select("doc_id", F.expr("if(quality = 1, if(toxic = 1, 1, 2), 0)").alias("grade"))
    return graded(table(spark, sf, "documents"), ratings)


@query("op10_toxicity")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    from spanledger.llm.toxicity import toxicity
    return toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op6_decontamination")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    from spanledger.llm.decontaminate import decontaminated
    return decontaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


WHOLE_SQL = """
k as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)"""


def codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2, size: int = 4) -> str:
    """The twin of op12 for vectors of ``parts * size`` components."""
    x = [f"x{i}" for i in range(size)]
    cut = ", ".join(f"v[p * {size} + {i + 1}] as x{i}" for i in range(size))
    far = " + ".join(f"(k.{c} - b.{c}) * (k.{c} - b.{c})" for c in x)
    steps = [f"with {WHOLE_SQL}", f"w as materialized (select vec_id, label, p, {cut} from k, range({parts}) as r(p))",
             f"b0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, {', '.join(x)} from w "
             f"where vec_id in (select vec_id from k order by vec_id limit {entries}))"]
    for i in range(rounds + 1):
        steps.append(f"a{i} as materialized (select k.vec_id, k.p, min(({far}) * {entries} + b.e) as m from w k join b{i} b on k.p = b.p group by all)")
        if i < rounds:
            mean = ", ".join(f"coalesce(cast(floor(cast(sum(w.{c}) as double) / count(w.{c})) as bigint), any_value(b.{c})) as {c}" for c in x)
            steps.append(f"b{i + 1} as materialized (select b.p, b.e, {mean} from b{i} b left join (select a.p, a.m % {entries} as e, {', '.join(x)} "
                         f"from a{i} a join w on a.vec_id = w.vec_id and a.p = w.p) w on b.p = w.p and b.e = w.e group by b.p, b.e)")
    said = ", ".join(x)
    return ",\n".join(steps) + f""",
c as (select vec_id, string_agg(printf('%02x', m % {entries}), '' order by p) as code, cast(sum(m // {entries}) as bigint) as error from a{rounds} group by vec_id)
select c.vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(concat_ws(',', {said}), ',' order by p, e)) from b{rounds}) as codebooks_sha256
from c join k on c.vec_id = k.vec_id
"""


@query("op12_vector_codes", codes_sql())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    from spanledger.llm.vector_codes import vector_codes
    return vector_codes(table(spark, sf, "embeddings")).drop("label")


NEGATIVES_SQL = f"""
with {WHOLE_SQL},
r as (select vec_id, if(vec_id % 7 = 0, (label + 1) % 10, label) as label, v from k where label is not null),
s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, cast(list_inner_product(cast(a.v as double[]), cast(b.v as double[])) as bigint) as s
  from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select * from s where same qualify row_number() over (partition by a order by s desc, b) <= 5),
n as (select p.a, p.b as p, s.b as n, p.s as ps, s.s as ns, row_number() over (partition by p.a, p.b order by s.s desc, s.b) as rank
  from p join s on p.a = s.a and not s.same where 30 * p.s <= 100 * s.s and 100 * s.s <= 90 * p.s)
select a as anchor_id, p as positive_id, cast(rank as int) as rank, n as negative_id, ps as positive_score, ns as negative_score from n where rank <= 10
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    from spanledger.llm.hard_negatives import hard_negatives
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


@query("op11_language_id")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    from spanledger.llm.language_id import language_ids
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    return language_ids(table(spark, sf, "documents"), ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
