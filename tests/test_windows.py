"""Two-level windows against plain Python on a table where one key holds most rows."""

import random

from pyspark.sql import functions as F

from spanledger.operators import windows as X

random.seed(7)
ROWS = sorted({(random.choice("aaaaaaabc"), random.randrange(3000)) for _ in range(900)})
DATA = [(k, p, random.choice(["x", "x", "x", "y"]), random.randrange(5)) for k, p in ROWS]


def frame(spark):
    return spark.createDataFrame(DATA, "k string, p long, v string, w long")


def groups():
    out = {}
    for row in DATA:
        out.setdefault(row[0], []).append(row)
    return out


def test_running(spark):
    d = X.running(frame(spark), ["k"], ["p"], F.expr("p div 50"), sums={"s": F.col("w")},
                  maxes={"m": F.when(F.col("v") == "y", F.col("p"))}, last={"prev": F.col("v")})
    got = {(r.k, r.p): (r.s, r.m, r.prev) for r in d.collect()}
    for k, rows in groups().items():
        total, top, prev = 0, None, None
        for _, p, v, w in rows:
            total, top = total + w, p if v == "y" else top
            assert got[k, p] == (total, top, prev)
            prev = v


def test_runs_and_pieces(spark):
    got = {(r.k, r.p): (r.run_no, r.piece_no) for r in
           X.runs(frame(spark), ["k"], ["p"], "v", F.expr("p div 50"), piece=3).collect()}
    for k, rows in groups().items():
        run, pos, prev = 0, 0, None
        for _, p, v, _ in rows:
            run, pos = (run, pos + 1) if v == prev else (run + 1, 0)
            assert got[k, p] == (run, pos // 3 + 1)
            prev = v


def test_window_counts(spark):
    d = frame(spark)
    anchors = d.where("v = 'y'").select("k", "p")
    got = {(r.k, r.p): (r.n, r.s) for r in X.window_counts(
        anchors, d, ["k"], "p", 30, 40, 100, {"n": F.lit(1), "s": F.col("w")}).collect()}
    assert len(got) == sum(r[2] == "y" for r in DATA)
    for (k, p), (n, s) in got.items():
        near = [r for r in groups()[k] if p - 30 <= r[1] <= p + 40]
        assert (n, s) == (len(near), sum(r[3] for r in near))


def test_stride_samples(spark):
    d = frame(spark)
    got = {}
    for r in X.stride_sample(d, "k", "p").collect():
        got.setdefault(r.k, set()).add(r.p)
    cells = {}
    for r in X.cell_stride_sample(d, ["k"], ["p"], F.expr("p div 50")).collect():
        cells.setdefault(r.k, set()).add(r.p)
    for k, rows in groups().items():
        ids = [r[1] for r in rows]
        assert got[k] == set(ids if len(ids) <= 20 else ids[::7][:20])
        step = max(1, len(ids) // min(len(ids), max(20, len(ids) // 100)))
        assert cells[k] == set(ids[::step])


def test_group_limit_runs_before_the_shuffle(spark):
    d = X.first_per_group(frame(spark), ["k"], ["p"], 5)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
