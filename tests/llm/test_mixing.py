import math

import pytest
from pyspark.sql import functions as F

from spanledger.llm.mixing import mixed, queued
from spanledger.llm.queries import ORACLES, QUERIES
from spanledger.operators.support import Shelf
from tools.compare import compare, connect

SF = "/root/testdata/sf0.01"


def filled(sizes, weights, share=1.0, rounds=3):
    """Targets by repeated resharing, as the contract words it."""
    target = dict.fromkeys(sizes, 0.0)
    left, open_ = math.floor(sum(sizes.values()) * share), set(sizes)
    while open_ and left > 1e-6:
        unit = left / sum(weights[s] for s in open_)
        for s in open_:
            target[s] += unit * weights[s]
        left = sum(target[s] - rounds * sizes[s] for s in open_ if target[s] > rounds * sizes[s])
        full = {s for s in open_ if target[s] >= rounds * sizes[s]}
        for s in full:
            target[s] = rounds * sizes[s]
        open_ -= full
    return target


def test_against_sql_and_targets(spark):
    got = QUERIES["op1_mixing"](spark, SF).toPandas()
    assert compare(got, connect(SF).execute(ORACLES["op1_mixing"]).fetchdf()) == "ok"
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").toPandas()
    rows = got.merge(docs, on="doc_id")
    sizes = rows.groupby("source")["size"].sum().to_dict()
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: s.encode("utf-32-be")))}
    want = filled(sizes, weights)
    for s, part in rows.groupby("source"):
        assert part["target"].iloc[0] == pytest.approx(want[s])
        assert abs(part["taken"].sum() - want[s]) <= part["size"].max()
    assert (got["taken"] <= 3 * got["size"]).all() and got["taken"].sum() <= got["size"].sum()


ROWS = [(1, "a b c", None), (2, None, "x"), (3, "", "x"), (4, "one " * 5000, "x"), (5, "d e", "y"), (5, "d e", "y"), (6, "f", "z")]


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, 1, 2) for r in ROWS], "doc_id long, text string, source string, h int, target int")
    got = queued(df, Shelf(spark)).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: r.size for r in got} == {1: 3, 2: 0, 3: 0, 4: 5000, 5: 2, 6: 1}
    assert {r.taken for r in got if r.doc_id in (2, 3)} == {0}
    assert all(r.taken in range(0, 3 * r.size + 1, max(r.size, 1)) for r in got)
    rows = mixed(df).collect()
    assert {r.doc_id for r in rows} <= {1, 4, 5, 6} and df.columns == list(rows[0].asDict())
    assert queued(df.limit(0), Shelf(spark)).collect() == [] and mixed(df.limit(0)).collect() == []


def test_mixed_holds_the_planned_copies_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = {r.doc_id: r.taken // r.size for r in queued(docs, Shelf(spark)).where("taken > 0").collect()}
    held = mixed(docs)
    assert {r.doc_id: r.n for r in held.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == plan


def test_given_weights_and_share(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(4000)], "doc_id long, text string, source string")
    w = spark.createDataFrame([("a", 1), ("b", 3)], "source string, weight long")
    got = {r.source: (r.t, r.n) for r in queued(docs, Shelf(spark), w, .5).groupBy("source").agg(
        F.first("target").alias("t"), F.sum("taken").alias("n")).collect()}
    assert got["b"][0] == pytest.approx(3 * got["a"][0])
    assert all(abs(t - n) <= 7 for t, n in got.values())


@pytest.mark.parametrize("one", [None, 7])
def test_rows_of_one_id_are_decided_each(spark, one):
    """The words of the mix keep to budget and targets where ids are null or repeated, and equal rows are counted."""
    texts = [f"w{i} " * (i % 3 + 1) for i in range(1200)] + ["same words here"] * 300 + ["", None]
    docs = spark.createDataFrame([(one, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    plan = {r.source: r for r in queued(docs, Shelf(spark)).groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum(F.size("finish")).alias("copies")).collect()}
    held = {r.source: r for r in mixed(docs).groupBy("source").agg(
        F.sum(F.size(F.split(F.trim("text"), " "))).alias("taken"), F.count("*").alias("copies")).collect()}
    assert {s: (r.taken, r.copies) for s, r in held.items()} == {s: (r.taken, r.copies) for s, r in plan.items()}
    assert all(abs(held[s].taken - plan[s].target) <= 3 for s in "ab")
