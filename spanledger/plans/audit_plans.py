"""Queries of the table audits: rules as data, all references at once, drift of a catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanledger.operators.references import Reference, reference_violations
from spanledger.operators.rules import RULE, judged_by_table
from spanledger.operators.snapshots import drift, store
from spanledger.operators.support import Shelf
from spanledger.plans.base import query, table

# Views with planted faults, in SQL that both engines read.
_ORDERS = ["o_orderkey", "case when o_orderkey % 1000 = 1 then ' ' else o_orderstatus end as status",
           "case when o_orderkey % 1000 = 2 then '9-ODD' else o_orderpriority end as priority",
           "case when o_orderkey % 2 = 0 then o_custkey end as buyer", "case when o_orderkey % 2 = 1 or o_orderkey % 1000 = 4 then o_custkey end as agent",
           "case when o_orderkey % 100 <> 7 then cast(o_orderdate as varchar(30)) end as closed"]
_EVENTS = ["event_id", "event_type", """case when event_id % 500 = 3 then '{"k": 1, "zz": {"k": 2}}' when event_id % 500 = 4 then '[1]' else props end as props""",
           "case when event_id % 40 = 5 then 'seen' end as note", "cast(user_id as varchar(20)) as user_id"]
_DOCS = ["doc_id", "case when doc_id % 2 = 0 then 'governing' else 'reference' end as tier", "lang",
         "case when doc_id % 2 = 0 or doc_id % 100 = 1 then 'yes' end as attested", "case when doc_id % 77 = 0 then 'xx' else lang end as declared"]
_GRID = """select source || '/' || lang as cell, case when count(*) < 40 then 'unavailable' else 'available' end as status,
  case when lang <> 'es' then 'few' end as reason from documents group by source, lang"""
RULES = [
    ("orders", "status-missing", "required", "status", None, None, None),
    ("orders", "priority-unknown", "enum", "priority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], None, None),
    ("orders", "two-parties", "one-of", None, ["buyer", "agent"], None, None),
    ("orders", "final-not-closed", "conditional", "closed", None, "status", "F"),
    ("orders", "clerk-missing", "conditional", "clerk", None, "priority", "9-ODD"),
    ("events", "key-undeclared", "undeclared", "props", ["k"], None, None),
    ("events", "note-on-view", "forbidden", "note", None, "event_type", "view"),
    ("events", "user-not-short", "pattern", "user_id", ["^[0-9]{1,2}$"], None, None),
    ("documents", "attested-reference", "forbidden", "attested", None, "tier", "reference"),
    ("documents", "language-differs", "agrees", "declared", None, "lang", None),
    ("grid", "unavailable-without-reason", "conditional", "reason", None, "status", "unavailable"),
    ("ledgers", "never", "required", "x", None, None, None),
]


def _sql(checks) -> str:
    return " union all ".join(f"select '{t}' as table_name, '{code}' as code, cast({key} as varchar) as key from {t}_v where {cond}" for t, code, key, cond in checks)


@query("rule_table", f"""
with orders_v as (select {", ".join(_ORDERS)} from orders), events_v as (select {", ".join(_EVENTS)} from events),
documents_v as (select {", ".join(_DOCS)} from documents), grid_v as ({_GRID})
""" + _sql([("orders", "status-missing", "o_orderkey", "trim(coalesce(status, '')) = ''"),
            ("orders", "priority-unknown", "o_orderkey", "priority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')"),
            ("orders", "two-parties", "o_orderkey", "(buyer is null) = (agent is null)"),
            ("orders", "final-not-closed", "o_orderkey", "status = 'F' and closed is null"),
            ("orders", "clerk-missing", "o_orderkey", "priority = '9-ODD'"),
            ("events", "key-undeclared", "event_id", "len(list_filter(coalesce(json_keys(props), []), lambda k: k <> 'k')) > 0"),
            ("events", "note-on-view", "event_id", "event_type = 'view' and note is not null"),
            ("events", "user-not-short", "event_id", "not regexp_matches(user_id, '^[0-9]{1,2}$')"),
            ("documents", "attested-reference", "doc_id", "tier = 'reference' and attested is not null"),
            ("documents", "language-differs", "doc_id", "declared is distinct from lang"),
            ("grid", "unavailable-without-reason", "cell", "status = 'unavailable' and reason is null")])
       + " union all select 'ledgers', 'no-such-table', null")
def rule_table(spark, sf):
    documents = table(spark, sf, "documents")
    grid = documents.groupBy("source", "lang").agg(F.count("*").alias("n")).select(
        F.concat_ws("/", "source", "lang").alias("cell"), F.when(F.col("n") < 40, "unavailable").otherwise("available").alias("status"),
        F.when(F.col("lang") != "es", "few").alias("reason"))
    tables = {"orders": (table(spark, sf, "orders").selectExpr(*_ORDERS), "o_orderkey"),
              "events": (table(spark, sf, "events").selectExpr(*_EVENTS), "event_id"),
              "documents": (documents.selectExpr(*_DOCS), "doc_id"), "grid": (grid, "cell")}
    return judged_by_table(tables, spark.createDataFrame(RULES, RULE)).select("table_name", "code", "key")


REFERENCES = [Reference("line-order", "lineitem", "l_orderkey", "orders", "o_orderkey", True),
              Reference("line-part", "lineitem", "l_partkey", "part", "p_partkey", True),
              Reference("line-supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
              Reference("order-customer", "orders", "o_custkey", "customer", "c_custkey", True),
              Reference("event-customer", "events", "user_id", "customer", "c_custkey", True),
              Reference("label-document", "labels", "doc_id", "documents", "doc_id", True),
              Reference("customer-nation", "customer", "c_nationkey", "nation", "n_nationkey"),
              Reference("supplier-nation", "supplier", "s_nationkey", "nation", "n_nationkey")]
_LINES = ["case when l_orderkey % 997 = 3 then -l_orderkey when l_orderkey % 997 = 4 then null else l_orderkey end as l_orderkey",
          "case when l_linenumber = 6 and l_partkey % 50 = 1 then l_partkey + 1000000 else l_partkey end as l_partkey", "l_suppkey"]


def _reference_sql() -> str:
    both = []
    for c in REFERENCES:
        child = "lines" if c.child == "lineitem" else c.child
        both.append(f"""select '{c.name}' as check_name, 'unresolved' as code, cast({c.column} as varchar) as key, count(*) as n from {child}
          where {c.column} is not null and {c.column} not in (select {c.key} from {c.parent}) group by all""")
        if c.reverse:
            both.append(f"""select '{c.name}', 'no-child', cast({c.key} as varchar), 0 from {c.parent}
              where {c.key} not in (select {c.column} from {child} where {c.column} is not null)""")
    return f"with lines as (select {', '.join(_LINES)} from lineitem) " + " union all ".join(both)


@query("reference_check", _reference_sql())
def reference_check(spark, sf):
    names = {t for c in REFERENCES for t in (c.child, c.parent)}
    tables = {t: table(spark, sf, t) for t in names}
    tables["lineitem"] = tables["lineitem"].selectExpr(*_LINES)
    return reference_violations(tables, REFERENCES)


_KEPT = {"customer": (["c_custkey", "c_name", "c_nationkey", "case when c_custkey % 70 = 3 then c_acctbal + 1 else c_acctbal end as c_acctbal", "c_mktsegment"],
                      "c_custkey", "c_custkey % 90 <> 5"),
         "part": (["*"], "p_partkey", "true"), "supplier": (["*"], "s_suppkey", "true"),
         "embeddings": (["vec_id", "embedding", "case when vec_id % 250 = 9 then label + 1 else label end as label"], "vec_id", "true")}
_FRESH = {"customer": "c_custkey", "part": "p_partkey", "embeddings": "vec_id", "orders": "o_orderkey"}


def _drift_sql() -> str:
    parts = ["select 'supplier' as table_name, 'missing-table' as code, cast(null as varchar) as key, 1 as n", "select 'orders', 'extra-table', null, 1"]
    for t in ("customer", "part", "embeddings"):
        columns, key, where = _KEPT[t]
        names = [c.rsplit(" as ", 1)[-1] for c in columns]
        fresh, kept = f"select {', '.join(names)} from {t}", f"select {', '.join(columns)} from {t} where {where}"
        for code, a, b in (("only-fresh", fresh, kept), ("only-kept", kept, fresh)):
            parts.append(f"select '{t}', '{code}', cast({key} as varchar), count(*) from ({a} except all {b}) group by {key}")
    return " union all ".join(parts)


@query("catalogue_drift", _drift_sql())
def catalogue_drift(spark, sf):
    """Two stored snapshots of the tables; the kept one lacks a table and rows, and has others changed."""
    root = Shelf(spark).root
    store({t: (table(spark, sf, t), k) for t, k in _FRESH.items()}, f"{root}/fresh")
    store({t: (table(spark, sf, t).where(w).selectExpr(*c), k) for t, (c, k, w) in _KEPT.items()}, f"{root}/kept")
    return drift(spark, f"{root}/fresh", f"{root}/kept")
