"""Rules as data, references in one pass, and drift of stored snapshots."""

import pathlib

import pytest
from pyspark.sql import functions as F

from spanledger.operators.references import Reference, reference_violations
from spanledger.operators.rules import RULE, judged_by_table
from spanledger.operators.snapshots import drift, store, unequal_buckets


def rule(kind, column=None, listed=None, other=None, equals=None, code=None, table="t"):
    return (table, code or kind, kind, column, listed, other, equals)


def test_each_kind_of_rule(spark):
    rows = [(1, "a", "x", None, '{"k": 1}', "F"), (2, " ", "x", "y", '{"k": 1, "z": 2}', "F"), (3, None, None, None, "no json", None), (4, "b", None, "q", None, "G")]
    df = spark.createDataFrame(rows, "id int, name string, p string, q string, props string, status string")
    rules = [rule("required", "name"), rule("enum", "name", ["a", " "]), rule("one-of", None, ["p", "q"]), rule("conditional", "q", None, "status", "F"),
             rule("forbidden", "p", None, "status", "F"), rule("forbidden", "q", code="never-q"), rule("undeclared", "props", ["k"]), rule("agrees", "p", None, "q"),
             rule("pattern", "name", ["^a$"]), rule("required", "absent", code="absent"), rule("forbidden", "absent", code="unset"), rule("enum", "x", ["1"], table="gone")]
    got = sorted((r.code, r.key) for r in judged_by_table({"t": (df, "id")}, spark.createDataFrame(rules, RULE)).collect() if r.key)
    assert got == sorted([("required", "2"), ("required", "3"), ("enum", "4"), ("one-of", "2"), ("one-of", "3"), ("conditional", "1"), ("forbidden", "1"),
                          ("forbidden", "2"), ("never-q", "2"), ("never-q", "4"), ("undeclared", "2"), ("agrees", "1"), ("agrees", "2"), ("agrees", "4"),
                          ("pattern", "2"), ("pattern", "4"), *[("absent", str(i)) for i in (1, 2, 3, 4)]])
    assert [(r.table_name, r.code) for r in judged_by_table({"t": (df, "id")}, spark.createDataFrame(rules, RULE)).where("key is null").collect()] == [
        ("gone", "no-such-table")]


def test_one_scan_a_table_and_unknown_kinds(spark, tmp_path):
    spark.range(5).selectExpr("id", "cast(id as string) as a", "'x' as unused").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    rules = spark.createDataFrame([rule("required", "a", code=f"c{i}") for i in range(6)], RULE)
    plan = judged_by_table({"t": (df, "id")}, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "unused" not in plan
    with pytest.raises(ValueError, match="no such kind"):
        judged_by_table({"t": (df, "id")}, spark.createDataFrame([rule("odd", "a")], RULE))


def test_references_in_both_directions(spark, tmp_path):
    spark.createDataFrame([(1, 10), (1, 11), (2, None), (9, 10), (9, 99), (None, 10)], "a int, b int").write.parquet(f"{tmp_path}/c")
    child = spark.read.parquet(f"{tmp_path}/c")
    left, right = spark.createDataFrame([(1,), (2,), (3,)], "a int"), spark.createDataFrame([(10,), (11,), (12,)], "b int")
    checks = [Reference("c-left", "c", "a", "left", "a", True), Reference("c-right", "c", "b", "right", "b"), Reference("right-right", "right", "b", "right", "b")]
    found = reference_violations({"c": child, "left": left, "right": right}, checks)
    assert sorted(map(tuple, found.collect())) == [("c-left", "no-child", "3", 0), ("c-left", "unresolved", "9", 2), ("c-right", "unresolved", "99", 1)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_drift_opens_only_buckets_that_differ(spark, tmp_path):
    rows = spark.range(400).select("id", F.array((F.col("id") / 7).cast("float"), F.lit(float("nan")).cast("float")).alias("v"), F.lit("u").alias("noise"))
    changed = rows.where("id <> 5").withColumn("v", F.when(F.col("id") == 8, F.array(F.lit(0.1).cast("float"))).otherwise(F.col("v")))
    other = spark.range(3).select("id")
    store({"t": (rows, "id"), "same": (rows, "id"), "new": (other, "id"), "void": (other.where("false"), "id")}, f"{tmp_path}/fresh", 32)
    store({"t": (changed.union(rows.where("id = 9")), "id"), "same": (rows.withColumn("noise", F.col("noise")), "id"), "old": (other, "id"),
           "void": (other.withColumn("more", F.lit(1)).where("false"), "id")}, f"{tmp_path}/kept", 32)
    fresh, kept = f"{tmp_path}/fresh", f"{tmp_path}/kept"
    unequal = unequal_buckets(spark, fresh, kept)
    assert 1 <= len(unequal["t"]) <= 3 and "same" not in unequal
    damaged = 0
    for root in (fresh, kept):
        for file in pathlib.Path(f"{root}/tables").rglob("*.parquet"):
            name, bucket = file.parent.parent.name, int(file.parent.name.split("=")[1])
            if bucket not in unequal.get(name, []):
                file.write_bytes(b"damaged")
                (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
                damaged += 1
    assert damaged > 60
    got = sorted(map(tuple, drift(spark, fresh, kept).collect()), key=repr)
    assert got == sorted([("new", "extra-table", None, 1), ("old", "missing-table", None, 1), ("void", "schema", None, 1), ("t", "only-fresh", "5", 1),
                          ("t", "only-fresh", "8", 1), ("t", "only-kept", "8", 1), ("t", "only-kept", "9", 1)], key=repr)
    assert {(r.code, r.key) for r in drift(spark, fresh, kept, {"t": ["v"]}).where("table_name = 't'").collect()} == {("only-fresh", "5"), ("only-kept", "9")}
