"""Queries over the relational tables: crosswalks, integrity, drift, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.operators import integrity as I
from spanledger.operators import joins as J
from spanledger.operators import ledger as G
from spanledger.operators import receipts as R
from spanledger.operators.references import Reference, reference_violations
from spanledger.plans.base import query, sql_list, table, texts
from spanledger.sources import sinks
from spanledger.functions import text as T


@query("ordered_distinct_join", """
with f as (select o_orderkey, p_brand, min((l_linenumber, l_partkey)) as pos
  from orders left join lineitem on l_orderkey = o_orderkey left join part on p_partkey = l_partkey
  group by o_orderkey, p_brand)
select o_orderkey, coalesce(string_agg(p_brand, ',' order by pos), '') as brands from f group by o_orderkey""")
def ordered_distinct_join(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    branded = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    d = table(spark, sf, "orders").select("o_orderkey").join(
        branded, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return J.ordered_distinct(d, "o_orderkey", F.struct("l_linenumber", "l_partkey"), "p_brand", "brands")


@query("latest_per_key", """
select o_custkey, o_orderkey, o_orderpriority from (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn
  from orders semi join customer on c_custkey = o_custkey) where rn = 1
union all
select c_custkey, -1, 'referenced-but-absent' from customer anti join orders on o_custkey = c_custkey""")
def latest_per_key(spark, sf):
    orders, cust = table(spark, sf, "orders"), table(spark, sf, "customer").select("c_custkey")
    kept = orders.join(cust, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    best = J.best_per_key(kept, ["o_custkey"], F.col("o_orderdate"), -F.col("o_orderkey"),
                          keep=["o_orderkey", "o_orderpriority"])
    absent = cust.join(orders.select("o_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return best.unionByName(absent.select(
        F.col("c_custkey").alias("o_custkey"), F.lit(-1).cast("bigint").alias("o_orderkey"),
        F.lit("referenced-but-absent").alias("o_orderpriority")))


# Parts as entries: a small part holds its own value, any other points to another part.
@query("pointer_chain", """
with recursive n as (
  select p_partkey as node, case when p_size <= 10 then null else (p_partkey * 7 + 3) % (m + 101) end as ptr
  from part, (select max(p_partkey) as m from part)),
walk as (
  select node, ptr as at, cast(1 as bigint) as hops, [node] as seen, false as cyc from n where ptr is not null
  union all
  select w.node, n.ptr, w.hops + 1, list_append(w.seen, w.at), list_contains(w.seen, n.ptr) or n.ptr = w.at
  from walk w join n on n.node = w.at where n.ptr is not null and not w.cyc),
ends as (
  select w.node, case when w.cyc then 'cycle' when n.node is null then 'dangling' else 'ok' end as status,
    case when w.cyc then -1 else w.at end as target, case when w.cyc then -1 else w.hops end as hops
  from walk w left join n on n.node = w.at where w.cyc or n.node is null or n.ptr is null)
select node, status, cast(target as bigint) as target, cast(hops as bigint) as hops from ends
union all select node, 'ok', node, 0 from n where ptr is null""")
def pointer_chain(spark, sf):
    part = table(spark, sf, "part")
    top = part.agg(F.max("p_partkey")).first()[0]
    nodes = part.select(F.col("p_partkey").alias("node"), F.when(
        F.col("p_size") > 10, (F.col("p_partkey") * 7 + 3) % (F.lit(top) + 101)).alias("same_as"))
    return J.resolve_pointers(nodes).withColumn("target", F.coalesce("target", F.lit(-1)).cast("bigint"))


@query("composite_left", """
with r as (select l_orderkey, l_suppkey, count(*) as n from lineitem group by all)
select o_orderkey, o_custkey % 100 as s_suppkey, coalesce(n, 0) as n, n is not null as captured
from orders left join r on l_orderkey = o_orderkey and l_suppkey = o_custkey % 100""")
def composite_left(spark, sf):
    slots = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("s_suppkey"))
    captured = table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return slots.join(captured, ["o_orderkey", "s_suppkey"], "left").select(
        "o_orderkey", "s_suppkey", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("captured"))


@query("reverse_links", """
select p_partkey, coalesce(l_suppkey // 1000, 0) as block_no,
  coalesce(string_agg(cast(l_suppkey as varchar), ',' order by l_suppkey), '') as members, count(l_suppkey) as n
from part left join (select distinct l_partkey, l_suppkey from lineitem) on l_partkey = p_partkey
group by p_partkey, l_suppkey // 1000""")
def reverse_links(spark, sf):
    links = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    return J.reverse_links(table(spark, sf, "part"), "p_partkey", links, "l_suppkey")


FKS = [("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
       ("nation", "n_regionkey", "region", "r_regionkey"), ("orders", "o_custkey", "customer", "c_custkey"),
       ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
       ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("documents", "doc_id", "labels", "doc_id"),
       ("labels", "doc_id", "documents", "doc_id"), ("conversations", "conv_id", "labels", "doc_id")]


def _fk_sql(c, fk, p, pk):
    return (f"select '{c}.{fk}' as check_name, 'unresolved' as code, cast({c}.{fk} as varchar) as key, count(*) as n "
            f"from {c} anti join {p} on {p}.{pk} = {c}.{fk} group by {c}.{fk}")


@query("fk_violations", " union all ".join(_fk_sql(*f) for f in FKS) + """
 union all select 'supplier-nation', 'attribute-s_nationkey', cast(s_suppkey as varchar), count(*)
  from lineitem join supplier on s_suppkey = l_suppkey where l_linenumber <> s_nationkey group by s_suppkey""")
def fk_violations(spark, sf):
    """All plain keys at once, each table scanned once for them; then the one key whose attributes must agree."""
    checks = [Reference(f"{c}.{fk}", c, fk, p, pk) for c, fk, p, pk in FKS]
    out = reference_violations({t: table(spark, sf, t) for c in checks for t in (c.child, c.parent)}, checks)
    agreed = I.fk_violations(table(spark, sf, "lineitem"), "l_suppkey", table(spark, sf, "supplier"), "s_suppkey",
                             "supplier-nation", [("l_linenumber", "s_nationkey")])
    agreed = agreed.withColumn("code", F.when(F.col("code") == "attribute-l_linenumber", "attribute-s_nationkey")
                               .otherwise(F.col("code")))
    return out.unionByName(agreed)


@query("table_diff", """
with t as (select l_orderkey as o_orderkey,
  sum(cast(l_extendedprice as decimal(15,2)) * cast(1 - l_discount as decimal(4,2))) as total, count(*) as n from lineitem group by 1),
h as (select o_orderkey, cast(o_totalprice as decimal(15,2)) as total, 1 + o_orderkey % 7 as n from orders)
select coalesce(h.o_orderkey, t.o_orderkey) as o_orderkey, code, column_name from h full join t on h.o_orderkey = t.o_orderkey,
  lateral (select 'missing' as code, '' as column_name where h.o_orderkey is null
    union all select 'extra', '' where t.o_orderkey is null
    union all select 'differs', 'total' where h.total <> t.total
    union all select 'differs', 'n' where h.n <> t.n)""")
def table_diff(spark, sf):
    price = F.col("l_extendedprice").cast("decimal(15,2)") * (1 - F.col("l_discount")).cast("decimal(4,2)")
    detail = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(price).cast("decimal(20,4)").alias("total"), F.count("*").alias("n"))
    header = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(20,4)").alias("total"),
        (F.col("o_orderkey") % 7 + 1).alias("n"))
    return I.table_diff(header, detail, ["o_orderkey"], ["total", "n"])


@query("table_diff_clean", """
select doc_id, 'differs' as code, 'n_chars' as column_name from documents where n_chars <> length(text)""")
def table_diff_clean(spark, sf):
    docs = texts(spark, sf, "documents")
    return I.table_diff(docs.select("doc_id", "n_chars"),
                        docs.select("doc_id", F.length("text").cast("bigint").alias("n_chars")),
                        ["doc_id"], ["n_chars"])


@query("missing_stale", """
with d as (select distinct cast(doc_id as varchar) as key from documents),
l as (select distinct cast(doc_id as varchar) as key from labels),
a as (select distinct unnest(string_split(text, chr(10))) as key from documents),
b as (select distinct unnest(string_split(text, chr(10))) as key from conversations)
select 'ids' as what, key, 'stale' as side from d anti join l using (key)
union all select 'ids', key, 'missing' from l anti join d using (key)
union all select 'lines', sha256(key), 'stale' from a anti join b using (key)
union all select 'lines', sha256(key), 'missing' from b anti join a using (key)""")
def missing_stale(spark, sf):
    ids = I.missing_stale(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")
    def lines(name):
        return texts(spark, sf, name).select(F.explode(T.lines_of(F.col("text"))).alias("line")).select(
            F.sha2("line", 256).alias("h"))
    return ids.withColumn("what", F.lit("ids")).unionByName(
        I.missing_stale(lines("documents"), lines("conversations"), "h").withColumn("what", F.lit("lines")))


@query("snapshot_drift", """
with a as (select o_custkey, o_orderstatus, count(*) as n from orders group by all),
b as (select o_custkey, max(o_orderstatus) as o_orderstatus, count(*) as n from orders group by o_custkey)
select *, 'only-fresh' as direction from (select * from a except all select * from b)
union all select *, 'only-kept' from (select * from b except all select * from a)""")
def snapshot_drift(spark, sf):
    orders = table(spark, sf, "orders")
    fresh = orders.groupBy("o_custkey", "o_orderstatus").agg(
        F.count("*").alias("n"), F.max("o_orderdate").alias("built_at"))
    kept = orders.groupBy("o_custkey").agg(
        F.max("o_orderstatus").alias("o_orderstatus"), F.count("*").alias("n"), F.min("o_orderdate").alias("built_at"))
    return I.snapshot_drift(fresh, kept, volatile=("built_at",))


@query("duplicate_keys", """
select 'lineitem' as tbl, cast(l_orderkey as varchar) || '|' || cast(l_linenumber as varchar) as key, count(*) as n
  from lineitem group by l_orderkey, l_linenumber having count(*) > 1
union all select 'documents', sha256(text), count(*) from documents group by text having count(*) > 1
union all select 'orders', cast(o_orderkey as varchar), count(*) from orders group by o_orderkey having count(*) > 1""")
def duplicate_keys(spark, sf):
    li = I.duplicate_keys(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber").select(
        F.lit("lineitem").alias("tbl"), F.concat_ws("|", "l_orderkey", "l_linenumber").alias("key"), "n")
    digests = table(spark, sf, "documents").select(F.sha2("text", 256).alias("key"))
    docs = I.duplicate_keys(digests, "key").select(F.lit("documents").alias("tbl"), "key", "n")
    orders = I.duplicate_keys(table(spark, sf, "orders"), "o_orderkey").select(
        F.lit("orders").alias("tbl"), F.col("o_orderkey").cast("string").alias("key"), "n")
    return li.unionByName(docs).unionByName(orders)


@query("completeness_grid", """
with c as (select c_custkey, unnest(range(1, 12)) as slot from customer),
p as (select distinct o_custkey as c_custkey, cast(month(o_orderdate) as bigint) as slot from orders)
select c_custkey, cast(slot as bigint) as slot, 'missing' as code from c anti join p using (c_custkey, slot)
union all select c_custkey, slot, 'unknown-slot' from p where slot not between 1 and 11""")
def completeness_grid(spark, sf):
    present = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.month("o_orderdate").cast("bigint").alias("slot"))
    return I.grid_gaps(table(spark, sf, "customer"), "c_custkey", list(range(1, 12)), "slot", "bigint", present)


@query("source_present", """
select lang, source from (select distinct lang, source from documents)
anti join (select distinct lang, source from documents semi join labels using (doc_id)) using (lang, source)""")
def source_present(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    labelled = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return docs.select("lang", "source").distinct().join(
        labelled.select("lang", "source").distinct(), ["lang", "source"], "left_anti")


@query("reconcile_counts", """
with a as (select o_orderstatus as k, count(*) as recorded from orders group by 1),
b as (select l_linestatus as k, count(distinct l_orderkey) as recounted from lineitem group by 1)
select k, coalesce(recorded, 0) as recorded, coalesce(recounted, 0) as recounted,
  case when recorded is null then 'unrecorded' when recounted is null then 'vanished'
    when recorded <> recounted then 'stale' else 'equal' end as status from a full join b using (k)""")
def reconcile_counts(spark, sf):
    recorded = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("k")).agg(F.count("*").alias("n"))
    recounted = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("k"), "l_orderkey").distinct()
    return I.reconcile(recorded, recounted.groupBy("k").agg(F.count("*").alias("n")), "k")


@query("curated_merge", """
with o as (select s_suppkey, s_nationkey, case when s_suppkey % 3 = 0 then '' else s_name end as explain, 'old' as page
  from supplier where s_acctbal < 6000),
n as (select s_suppkey, s_nationkey, 'fresh ' || s_name as explain, 'new' as page, s_suppkey % 2 = 0 as takes_arg
  from supplier where s_acctbal > 2000)
select coalesce(n.s_suppkey, o.s_suppkey) as s_suppkey, coalesce(n.s_nationkey, o.s_nationkey) as s_nationkey,
  coalesce(nullif(o.explain, ''), n.explain, '') as explain, coalesce(n.page, o.page) as page, coalesce(n.takes_arg, false) as takes_arg,
  case when n.s_suppkey is null then '10' else '' end as removed_in,
  case when o.s_suppkey is null then 'new' when n.s_suppkey is null then 'removed' else 'kept' end as state
from n full join o on n.s_suppkey = o.s_suppkey and n.s_nationkey = o.s_nationkey""")
def curated_merge(spark, sf):
    """Some texts of the old table are empty; only the new one knows takes_arg."""
    s, keys = table(spark, sf, "supplier"), ["s_suppkey", "s_nationkey"]
    old = s.where("s_acctbal < 6000").select(
        *keys, F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("explain"),
        F.lit("old").alias("page"), F.lit(None).cast("string").alias("removed_in"))
    new = s.where("s_acctbal > 2000").select(
        *keys, F.concat(F.lit("fresh "), "s_name").alias("explain"), F.lit("new").alias("page"),
        (F.col("s_suppkey") % 2 == 0).alias("takes_arg"))
    merged = J.merge_curated(old, new, keys, ["explain"], "10")
    return merged.withColumns({"explain": F.coalesce("explain", F.lit("")), "takes_arg": F.coalesce("takes_arg", F.lit(False)),
                               "removed_in": F.coalesce("removed_in", F.lit(""))})


@query("preferred_first", """
select p_brand, s_suppkey, r_name from (
  select p_brand, s_suppkey, r_name, row_number() over (partition by p_brand
    order by case when r_name = 'ASIA' then 0 else 1 end, r_regionkey, s_suppkey) as rn
  from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey
  join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey) where rn = 1""")
def preferred_first(spark, sf):
    place = (table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
             .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
             .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
             .select("s_suppkey", "r_regionkey", "r_name"))
    cited = (table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
             .join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
             .join(place, F.col("l_suppkey") == F.col("s_suppkey")))
    current_first = F.when(F.col("r_name") == "ASIA", 0).otherwise(1)
    return J.first_per_key(cited, ["p_brand"], current_first, F.col("r_regionkey"),
                           keep=["s_suppkey", "r_name"])


ORDER_RULES = [
    ("negative-total", "o_totalprice < 0", "o_totalprice < 0"),
    ("open-but-old", "o_orderstatus = 'O' and o_orderdate < timestamp '1996-01-01'",
     "o_orderstatus = 'O' and o_orderdate < timestamp '1996-01-01'"),
    ("unknown-status", "o_orderstatus not in ('F', 'O')", "o_orderstatus not in ('F', 'O')"),
    ("priority-form", "not o_orderpriority rlike '^[1-5]-[A-Z]+$'",
     "not regexp_matches(o_orderpriority, '^[1-5]-[A-Z]+$')"),
]
EVENT_RULES = [
    ("props-without-k", "get_json_object(props, '$.k') is null", "json_extract_string(props, '$.k') is null"),
    ("purchase-without-value", "event_type = 'purchase' and value <= 5", "event_type = 'purchase' and value <= 5"),
    ("unknown-type", "event_type not in ('view', 'click', 'purchase', 'signup')",
     "event_type not in ('view', 'click', 'purchase', 'signup')"),
]


def _rules_sql(tbl, key, rules):
    return " union all ".join(f"select '{tbl}' as table_name, cast({key} as varchar) as key, '{c}' as code from {tbl} "
                              f"where {sql}" for c, _, sql in rules)


@query("rule_violations", _rules_sql("orders", "o_orderkey", ORDER_RULES) + " union all "
       + _rules_sql("events", "event_id", EVENT_RULES))
def rule_violations(spark, sf):
    out = None
    for tbl, key, rules in (("orders", "o_orderkey", ORDER_RULES), ("events", "event_id", EVENT_RULES)):
        v = I.rule_violations(table(spark, sf, tbl), tbl, F.col(key), [(c, F.expr(e)) for c, e, _ in rules])
        out = v if out is None else out.unionByName(v)
    return out


@query("empty_guard", f"""
with v as ({_rules_sql("orders", "o_orderkey", ORDER_RULES)}),
c as (select 'orders' as table_name, count(*) as rows_checked from orders
  union all select 'urgent-refunds', count(*) from orders where o_totalprice < -1
  union all select 'customer', count(*) from customer)
select table_name, rows_checked, cast(coalesce(n, 0) as bigint) as violations,
  case when rows_checked = 0 then 'EMPTY' when n > 0 then 'FAIL' else 'PASS' end as status
from c left join (select table_name, count(*) as n from v group by 1) using (table_name)""")
def empty_guard(spark, sf):
    orders = table(spark, sf, "orders")
    v = I.rule_violations(orders, "orders", F.col("o_orderkey"), [(c, F.expr(e)) for c, e, _ in ORDER_RULES])
    def counted(df, name):
        return df.agg(F.count("*").alias("rows_checked")).select(F.lit(name).alias("table_name"), "rows_checked")
    checked = (counted(orders, "orders").unionByName(counted(orders.where("o_totalprice < -1"), "urgent-refunds"))
               .unionByName(counted(table(spark, sf, "customer"), "customer")))
    return I.check_summary(v, checked, "table_name")


@query("violation_report", f"""
select code, position, key from (
  select code, key, row_number() over (partition by code order by length(key), key) as position
  from ({_rules_sql("orders", "o_orderkey", ORDER_RULES)})) where position <= 8""")
def violation_report(spark, sf):
    from spanledger.operators.windows import first_per_group
    v = I.rule_violations(table(spark, sf, "orders"), "orders", F.col("o_orderkey"),
                          [(c, F.expr(e)) for c, e, _ in ORDER_RULES])
    return first_per_group(v, ["code"], [F.length("key"), F.col("key")], 8).select(
        "code", F.col("position").cast("bigint").alias("position"), "key")


# Caps per nation and segment are half the number of customers there; one segment has no owner, one has a
# date that has passed.
@query("ratchet", """
with cur as (select c_nationkey, c_mktsegment, count(*) as residue from customer where c_acctbal < 5000 group by all),
base as (select c_nationkey, c_mktsegment, count(*) // 2 as cap,
    case c_mktsegment when 'BUILDING' then '' else 'owner' end as owner,
    case c_mktsegment when 'MACHINERY' then '2026-01-31' when 'FURNITURE' then 'soon' else '2027-01-31' end as retire_by
  from customer where c_nationkey < 20 group by all)
select c_nationkey, c_mktsegment, coalesce(residue, -1) as residue, coalesce(cap, -1) as cap,
  case when cap is null then 'new-cell' when residue is null then 'missing-row' when owner = '' then 'no-owner'
    when retire_by = 'soon' then 'bad-date' when retire_by < '2026-09-17' then 'expired'
    when residue > cap then 'grew' when residue < cap then 'improved' else 'held' end as status
from cur full join base using (c_nationkey, c_mktsegment)""")
def ratchet(spark, sf):
    cust = table(spark, sf, "customer")
    cur = cust.where("c_acctbal < 5000").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("residue"))
    seg = F.col("c_mktsegment")
    base = (cust.where("c_nationkey < 20").groupBy("c_nationkey", "c_mktsegment")
            .agg(F.expr("count(*) div 2").alias("cap"))
            .withColumn("owner", F.when(seg == "BUILDING", "").otherwise("owner"))
            .withColumn("retire_by", F.when(seg == "MACHINERY", "2026-01-31").when(seg == "FURNITURE", "soon")
                        .otherwise("2027-01-31")))
    return G.ratchet(cur, base, ["c_nationkey", "c_mktsegment"], "residue", "cap", "2026-09-17")


@query("hash_binding", """
with d as (select doc_id, text, case when n_chars % 10 = 0 then sha256(upper(text)) when n_chars % 10 = 1
    then upper(sha256(text)) else sha256(text) end as stored, quality from documents left join labels using (doc_id))
select doc_id, code from d, lateral (
  select 'digest-form' as code where not regexp_matches(stored, '^[0-9a-f]{64}$')
  union all select 'digest' where sha256(text) <> stored
  union all select 'not-attested' where coalesce(quality, 0) <> 1)""")
def hash_binding(spark, sf):
    tail = F.col("n_chars") % 10
    stored = (F.when(tail == 0, F.sha2(F.upper("text"), 256)).when(tail == 1, F.upper(F.sha2("text", 256)))
              .otherwise(F.sha2("text", 256)))
    # Texts are digested before the join, so only digests are shuffled.
    d = texts(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("actual"), stored.alias("stored"))
    d = d.join(table(spark, sf, "labels"), "doc_id", "left")
    codes = F.array_compact(F.array(
        F.when(~F.col("stored").rlike(R.SHA256), "digest-form"), F.when(F.col("actual") != F.col("stored"), "digest"),
        F.when(F.coalesce("quality", F.lit(0)) != 1, "not-attested")))
    return d.select("doc_id", F.explode(codes).alias("code"))


# One receipt an event, as JSON text with planted faults; SHA stands for the engine's digest.
_RECEIPT = """concat('{"schema":"', case when event_id % 90 = 1 then 'receipt/0' else 'receipt/1' end, '","tool_version":"1.2","entry_id":"e', event_id,
 '","rhel_version":"', case when event_id % 90 = 2 then '6' else '8' end, '","target":"', case when event_id % 90 = 3 then ' ' else 'host' end,
 '","operator":"op","executed_at":"2024-01-01T00:00:00', case when event_id % 90 = 4 then '' else 'Z' end, '","ticket":"t","command":"run ', event_type,
 '","command_sha256":"', case when event_id % 90 = 5 then upper(SHA(concat('run ', event_type))) else SHA(concat('run ', event_type)) end,
 '","artifact_sha256":"', SHA('a'), '","content_fingerprint":"', case when event_id % 90 = 6 then 'f' else SHA('f') end,
 '","exit_code":', case when event_id % 90 = 7 then 'null' else '0' end, ',"stdout":"', event_type, '","stdout_sha256":"', SHA(case when event_id % 90 = 8 then 'x' else event_type end),
 '","stderr":"",', case when event_id % 90 = 9 then '' else concat('"stderr_sha256":"', SHA(''), '",') end, '"verification":"v","attestation":{"command_was_executed":',
 case when event_id % 90 = 10 then 'false' else 'true' end, ',"outputs_are_actual":', case when event_id % 90 = 11 then '"yes"' else 'true' end, ',"statement":"',
 case when event_id % 90 = 12 then '' else 's' end, case when event_id % 90 = 13 then '","more":"1' else '' end, '"}', case when event_id % 90 = 14 then ',"zz":1' else '' end,
 case when event_id % 90 = 15 then '' else '}' end)"""
_TEXTS = ["tool_version", "entry_id", "target", "operator", "ticket", "verification"]
_SHAS = ["command_sha256", "artifact_sha256", "content_fingerprint", "stdout_sha256", "stderr_sha256"]
_VALUE = "json_extract_string(b, '$.{0}')"


@query("receipt_rules", f"""
with r as (select event_id, case when json_valid(b) then b end as b from (select event_id, {_RECEIPT.replace('SHA(', 'sha256(')} as b from events)),
k as (select *, coalesce(json_keys(b), []) as own, len(list_filter({R.RECEIPT_FIELDS}, lambda f: not list_contains(coalesce(json_keys(b), []), f))) = 0 as whole from r)
select cast(event_id as varchar) as event_id, code from k, lateral (select 'not-an-object' as code where b is null
  union all select 'undeclared-' || f from (select unnest(own) as f) where b is not null and f not in {sql_list(R.RECEIPT_FIELDS)}
  union all select 'missing-' || f from (select unnest({R.RECEIPT_FIELDS}) as f) where b is not null and not list_contains(own, f)
  union all select 'schema' where whole and {_VALUE.format('schema')} <> 'receipt/1'
  union all select 'undeclared-attestation-' || f from (select unnest(json_keys(b, '$.attestation')) as f) where whole and f not in {sql_list(R.ATTESTATION_FIELDS)}
  """ + "".join(f"union all select 'empty-{c}' where whole and trim({_VALUE.format(c)}) = '' " for c in _TEXTS)
    + "".join(f"union all select 'digest-form-{c}' where whole and not regexp_matches({_VALUE.format(c)}, '^[0-9a-f]{{64}}$') " for c in _SHAS)
    + "".join(f"union all select 'digest-{c}' where whole and sha256({_VALUE.format(c)}) <> {_VALUE.format(c + '_sha256')} " for c in ("command", "stdout", "stderr"))
    + f"""union all select 'release' where whole and {_VALUE.format('rhel_version')} not in ('7', '8', '9', '10')
  union all select 'timestamp-zone' where whole and not regexp_matches({_VALUE.format('executed_at')}, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$')
  union all select 'exit-code' where whole and json_type(b, '$.exit_code') <> 'UBIGINT'
  union all select 'not-executed' where whole and {_VALUE.format('attestation.command_was_executed')} <> 'true'
  union all select 'outputs-not-actual' where whole and (json_type(b, '$.attestation.outputs_are_actual') <> 'BOOLEAN' or {_VALUE.format('attestation.outputs_are_actual')} <> 'true')
  union all select 'no-statement' where whole and trim({_VALUE.format('attestation.statement')}) = '')""")
def receipt_rules(spark, sf):
    """Execution receipts as JSON texts against all rules of a receipt."""
    digests = {"SHA(concat('run ', event_type))": "sha2(concat('run ', event_type), 256)", "SHA('a')": "sha2('a', 256)", "SHA('f')": "sha2('f', 256)",
               "SHA('')": "sha2('', 256)", "SHA(case when event_id % 90 = 8 then 'x' else event_type end)": "sha2(case when event_id % 90 = 8 then 'x' else event_type end, 256)"}
    body = _RECEIPT
    for said, spelled in digests.items():
        body = body.replace(said, spelled)
    receipts = texts(spark, sf, "events").select("event_id", F.expr(body).alias("body"))
    return R.receipt_text_violations(receipts, "event_id", "body", "receipt/1")


@query("doc_markup", r"""
select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '[ICBM]\(([^)]*)\)', '\1', 'g'), '[UL]\(([^)]*)\)', '\1', 'g'), 'R\(([^,)]*)[^)]*\)', '\1', 'g'),
  ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) as text, regexp_replace(slug, '\.txt$', '') as slug
from (select doc_id, concat('I(', substr(text, 1, 9), ') and R(', substr(text, 10, 5), ', note) U(', lang, ') ', substr(text, 15, 40)) as t,
  concat(source, case when doc_id % 3 = 0 then '.txt' when doc_id % 3 = 1 then '.txt.gz' else '' end) as slug from documents)""")
def doc_markup(spark, sf):
    d = texts(spark, sf, "documents").select("doc_id", F.expr(
        "concat('I(', substr(text, 1, 9), ') and R(', substr(text, 10, 5), ', note) U(', lang, ') ', substr(text, 15, 40))").alias("t"), F.expr(
        "concat(source, case when doc_id % 3 = 0 then '.txt' when doc_id % 3 = 1 then '.txt.gz' else '' end)").alias("slug"))
    return d.select("doc_id", T.strip_doc_markup(F.col("t")).alias("text"), T.guide_slug(F.col("slug")).alias("slug"))


@query("tri_state", """
with l as (select l_orderkey, count(*) filter (where l_linestatus <> 'F') as not_f from lineitem group by 1)
select o_orderkey as entry_id, o_orderstatus as release, case when o_orderpriority like '5%' then 'not verified'
  when not_f = 0 then 'verified' when not_f is not null then 'captured' else 'not verified' end as status
from orders left join l on l_orderkey = o_orderkey""")
def tri_state(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("entry_id"), F.col("o_orderstatus").alias("release"),
        F.col("o_orderpriority").startswith("5").alias("is_pointer"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("entry_id")).agg(
        F.count_if(F.col("l_linestatus") != "F").alias("not_f"))
    captured = orders.join(lines, "entry_id").select("entry_id", "release", "not_f")
    return R.verification_status(orders, captured.where("not_f = 0"), captured)


@query("receipt_audit", """
with cap as (select l_orderkey, min(l_suppkey) as sk from lineitem group by 1),
d as (select o.*, c_name, c_mktsegment, s_name, s_acctbal, sk, c_custkey from orders o join customer on c_custkey = o_custkey
  left join cap on l_orderkey = o_orderkey left join supplier on s_suppkey = sk)
select o_orderkey as entry_id, code from d, lateral (
  select 'no-capture' as code where sk is null
  union all select 'hash-mismatch' where sk is not null and o_orderstatus = 'P'
  union all select 'host-differs' where sk is not null and sk % 10 <> o_custkey % 10
  union all select 'command-changed' where sk is not null and o_orderpriority like '1%'
  union all select 'signer-not-qa' where c_mktsegment <> 'BUILDING'
  union all select 'capturer-not-sme' where sk is not null and s_acctbal <= 0
  union all select 'one-person' where sk = c_custkey)""")
def receipt_audit(spark, sf):
    """Orders as receipts signed by customers, first suppliers as capturers; people share numbers."""
    person = lambda n: F.concat(F.lit("Person "), F.regexp_extract(n, r"([0-9]+)$", 1))
    cust, sup = table(spark, sf, "customer"), table(spark, sf, "supplier")
    orders = table(spark, sf, "orders")
    host = lambda k: F.concat(F.lit("host-"), (F.col(k) % 10).cast("string"))
    release = F.lit("8").alias("release")
    signed = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("entry_id"), release,
        F.concat(person("c_name"), F.lit(" (QA)")).alias("signed_by"), host("o_custkey").alias("host"))
    first = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s_suppkey"))
    run = F.col("o_orderpriority")
    captures = (first.join(sup, "s_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("entry_id"), release, host("s_suppkey").alias("host"),
        F.upper(person("s_name")).alias("captured_by"), run.alias("command_as_run"),
        F.sha2(F.when(F.col("o_orderstatus") == "P", F.concat(run, F.lit("!"))).otherwise(run), 256)
        .alias("command_hash")))
    current = orders.select(F.col("o_orderkey").alias("entry_id"), release, F.when(
        run.startswith("1"), F.lit("changed")).otherwise(run).alias("command"))
    roster = (cust.select(person("c_name").alias("name"), F.when(
        F.col("c_mktsegment") == "BUILDING", F.array(F.lit("QA"))).otherwise(F.array()).alias("roles"))
        .unionByName(sup.select(person("s_name").alias("name"), F.when(
            F.col("s_acctbal") > 0, F.array(F.lit("SME"))).otherwise(F.array()).alias("roles"))))
    return R.receipt_audit(signed, captures, current, roster).select("entry_id", "code")


@query("attestation_needed", """
select o_orderkey as entry_id, case when o_orderpriority like '3%' then 'no-attestation' else 'not-qa' end as code
from orders join customer on c_custkey = o_custkey
where o_orderstatus <> 'O' and not o_orderpriority like '1%'
  and (o_orderpriority like '3%' or c_mktsegment <> 'BUILDING')""")
def attestation_needed(spark, sf):
    cust = table(spark, sf, "customer")
    pri = F.col("o_orderpriority")
    entries = table(spark, sf, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("entry_id"),
        F.when(F.col("o_orderstatus") != "O", "paraphrase-only").otherwise("verbatim-ok").alias("license_class"),
        F.when(pri.startswith("1"), "man 8 order").otherwise("a printed guide").alias("source_ref"),
        F.when(~pri.startswith("3"), F.col("c_name")).alias("attested_by"), F.lit("2026-09-17").alias("attested_on"))
    roster = cust.select(F.col("c_name").alias("name"), F.when(
        F.col("c_mktsegment") == "BUILDING", F.array(F.lit("QA"))).otherwise(F.array()).alias("roles"))
    return R.attestation_needed(entries, roster)


@query("category_counts", """
select o_orderstatus, cast(count(*) filter (where o_orderpriority like '1%') as bigint) as urgent,
  cast(count(*) filter (where o_orderpriority like '2%') as bigint) as high,
  cast(count(*) filter (where o_orderpriority not like '1%' and o_orderpriority not like '2%') as bigint) as other,
  count(distinct o_custkey) as customers from orders group by 1""")
def category_counts(spark, sf):
    p = F.col("o_orderpriority")
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count_if(p.startswith("1")).alias("urgent"), F.count_if(p.startswith("2")).alias("high"),
        F.count_if(~p.startswith("1") & ~p.startswith("2")).alias("other"),
        F.count_distinct("o_custkey").alias("customers"))


@query("argmax_tie", """
select r_regionkey, r_name, count(*) as n from supplier join nation on n_nationkey = s_nationkey
join region on r_regionkey = n_regionkey group by all order by n desc, r_regionkey limit 1""")
def argmax_tie(spark, sf):
    d = (table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
         .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
         .groupBy("n_regionkey").agg(F.sum("n").alias("n")))
    return (d.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("r_regionkey", "r_name", "n").orderBy(F.col("n").desc(), "r_regionkey").limit(1))


@query("facts", """
select 'documents' as fact, count(*) as n from documents union all select 'sources', count(distinct source) from documents
union all select 'labelled', count(*) from labels union all select 'orders', count(*) from orders
union all select 'customers-with-orders', count(distinct o_custkey) from orders
union all select 'lineitems', count(*) from lineitem union all select 'pages', count(*) from pages
union all select 'protected-texts', count(*) from benchmark""")
def facts(spark, sf):
    """Each table is scanned once for all its facts."""
    every = F.count("*")
    told = {"documents": {"documents": every, "sources": F.count_distinct("source")}, "labels": {"labelled": every},
            "orders": {"orders": every, "customers-with-orders": F.count_distinct("o_custkey")}, "lineitem": {"lineitems": every},
            "pages": {"pages": every}, "benchmark": {"protected-texts": every}}
    parts = []
    for name, own in told.items():
        counted = table(spark, sf, name).agg(*[c.alias(fact) for fact, c in own.items()])
        parts.append(counted.select(F.inline(F.array(*[F.struct(F.lit(fact).alias("fact"), F.col(f"`{fact}`").alias("n")) for fact in own]))))
    return reduce(DataFrame.unionByName, parts)


@query("rate_threshold", """
select source, count(*) as n, round_even(avg(quality), 4) as rate, avg(quality) >= 0.8 as accepted
from documents join labels using (doc_id) group by source""")
def rate_threshold(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.bround(F.avg("quality"), 4).alias("rate"),
                                   (F.avg("quality") >= 0.8).alias("accepted"))


@query("evidence_block", """
select o_orderkey, 'Order: ' || o_orderkey || chr(10) || 'Customer: ' || coalesce(c_name, 'not captured') || chr(10)
  || 'Segment: ' || coalesce(c_mktsegment, 'not captured') || chr(10)
  || 'Priority: ' || case when o_orderpriority like '5%' then 'not captured' else o_orderpriority end as block
from orders left join customer on c_custkey = o_custkey and c_acctbal > 0""")
def evidence_block(spark, sf):
    known = table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", "c_mktsegment")
    d = table(spark, sf, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    return d.select("o_orderkey", sinks.text_block([
        ("Order", F.col("o_orderkey").cast("string")), ("Customer", F.col("c_name")),
        ("Segment", F.col("c_mktsegment")),
        ("Priority", F.when(~F.col("o_orderpriority").startswith("5"), F.col("o_orderpriority")))]).alias("block"))


@query("canonical_json", """
select p_partkey, '{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_partkey":' || p_partkey
  || ',"p_size":' || p_size || '}' as line from part""")
def canonical_json(spark, sf):
    d = table(spark, sf, "part").select("p_size", "p_partkey", "p_name", "p_brand")
    return d.select("p_partkey", sinks.canonical_json(d).alias("line"))
