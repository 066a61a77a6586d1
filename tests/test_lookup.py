"""Stored index, phrase join and anchor lookup against plain restatements."""

import pathlib
import random

from pyspark.sql import functions as F

from spanledger.operators.index_store import StoredIndex, unresolved
from spanledger.operators.integrity import CLAIMS, resolve_anchors
from spanledger.operators.phrases import phrase_hits


def frame_rows():
    rnd = random.Random(4)
    words = ["red", "widget", "src1", "part#77", "under", "zeta.conf", "a", "x-9", "blue"]
    rows = [(k, f"{k}{i}", " ".join(rnd.choices(words, k=6))) for k in ("doc", "part") for i in range(60)]
    return rows + [("log", f"l{i}", "nothing here") for i in range(20)] + [("log", "empty", ""), ("log", "null", None)]


def test_index_search_equals_the_scan(spark, tmp_path):
    rows = frame_rows()
    frame = spark.createDataFrame(rows, "kind string, id string, hay string")
    index = StoredIndex.write(frame, f"{tmp_path}/i", buckets=8)
    queries = ["red widget", "idge", "part#77 x-9", "zeta.conf", "no-such-word", "##", "a"]
    got = sorted((r.query, r.id) for r in StoredIndex(spark, f"{tmp_path}/i").search(frame, queries).collect())
    assert got == sorted((q, i) for q in queries for _, i, h in rows if h is not None and all(t in h for t in q.split()))
    assert unresolved(index, frame).count() == 0
    moved = frame.withColumn("hay", F.when(F.col("id") == "l3", "else").otherwise(F.col("hay")))
    assert {(r.id, r.token, r.code) for r in unresolved(index, moved).collect()} == {
        ("l3", "nothing", "unresolved"), ("l3", "here", "unresolved"), ("l3", "else", "unposted")}


def test_postings_are_stored_as_lists(spark, tmp_path):
    """Odd ids, families and texts; a list holds 4,096 ids at most, and there are far fewer of them than postings."""
    from spanledger.operators import search
    rows = [("a", i, f"the w{i % 7} é_x\x00y") for i in range(9000)] + [(None, 5, "the null.family"), ("b", None, "the"), ("b", 7, "the the"), ("b", 7, "other"),
            ("b", -3, None), ("b", 8, ""), ("b", 9, "Éa Ab-c the")]
    frame = spark.createDataFrame(rows, "kind string, id long, hay string").coalesce(1)
    index = StoredIndex.write(frame, f"{tmp_path}/i", buckets=4)
    key = lambda d: sorted(map(str, d.select("kind", "id", "token").collect()))
    assert key(index.postings) == key(search.postings(frame, "id", "hay", "kind", min_len=1))
    assert index.lists.count() < 60 and index.lists.agg(F.max(F.size("id"))).first()[0] == 4096
    assert {r.token: r.n for r in index.vocabulary.where("kind = 'b'").collect()} == {"the": 3, "other": 1, "a": 1, "b-c": 1}
    assert sorted(r.id for r in index.search(frame, ["the"]).where("kind = 'b'").collect()) == [7, 7, 9]  # "other" holds it too


def test_parts_without_the_terms_are_not_read(spark, tmp_path):
    """The files of all families and buckets without a term are damaged; a search that opened one would fail."""
    frame = spark.createDataFrame(frame_rows(), "kind string, id string, hay string")
    index = StoredIndex.write(frame, f"{tmp_path}/i", buckets=8)
    used = {(r.kind, r.bucket) for r in index.vocabulary.where("token like '%widget%'").collect()}
    damaged = 0
    for file in pathlib.Path(f"{tmp_path}/i/postings").rglob("*.parquet"):
        kind, bucket = file.parent.parent.name.split("=")[1], int(file.parent.name.split("=")[1])
        if (kind, bucket) not in used:
            file.write_bytes(b"damaged")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
            damaged += 1
    assert used and damaged > len(used)
    found = {r.id for r in StoredIndex(spark, f"{tmp_path}/i").postings_of(["widget"]).collect()}
    assert found == {i for _, i, h in frame_rows() if h and "widget" in h.split()}
    plan = StoredIndex(spark, f"{tmp_path}/i").postings_of(["widget"])._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_phrases_against_contains(spark):
    rnd = random.Random(6)
    letters = 'abAB" \'-é'
    text = lambda n: "".join(rnd.choices(letters, k=rnd.randint(0, n)))
    lines = [(i, text(40)) for i in range(400)] + [(900, None), (901, "rm -rf '/'"), (902, "x" * 50_000 + "needle")]
    phrases = [(i, text(9)) for i in range(150)] + [(500, None), (501, ""), (502, "RM -rf /"), (503, "needle"), (504, "never there at all")]
    got = phrase_hits(spark.createDataFrame(lines, "k int, line string"), ["k"], "line", spark.createDataFrame(phrases, "phrase_id int, phrase string"))
    bare = lambda s: s.replace('"', "").replace("'", "")
    want = [(k, p) for k, line in lines if line is not None for p, ph in phrases if ph
            and (ph.lower() in line.lower() or ph.lower() in bare(line.lower()))]
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(p < 500 for _, p in want) and (902, 503) in want
    none = phrase_hits(spark.createDataFrame(lines, "k int, line string"), ["k"], "line",
                       spark.createDataFrame([], "phrase_id int, phrase string"))
    assert none.collect() == [] and none.columns == ["k", "phrase_id"]


def test_phrases_with_an_inner_word_cut_no_grams(spark, monkeypatch):
    from spanledger.operators import phrases as P
    monkeypatch.setattr(P, "_grams", None)
    lines = spark.createDataFrame([(1, "x red Blue green y"), (2, "red  blue green"), (3, "a red 'blue' greens"), (4, "blue"), (5, None)], "k int, line string")
    phrases = spark.createDataFrame([(1, "red blue green"), (2, "d BLUE g"), (3, "red blue gone")], "phrase_id int, phrase string")
    assert sorted(map(tuple, phrase_hits(lines, ["k"], "line", phrases).collect())) == [(1, 1), (1, 2), (3, 1), (3, 2)]


CLAIM = "claim_id string, family string, key string, field string, line_no long, line_to long, text string, verbatim boolean, exact boolean"


def test_three_anchor_shapes(spark):
    texts = spark.createDataFrame([("d", "1", "text", "alpha\n beta gamma\ndelta", False), ("d", "2", "text", "one\ntwo", True), ("d", "3", "text", None, False)],
                                  "family string, key string, field string, body string, joined boolean")
    told = [("ok-line", "1", 2, None, "beta", True, False, None), ("exact", "1", 2, None, "beta gamma", False, True, "text-not-on-line"),
            ("ok-exact", "1", 2, None, " beta gamma", False, True, None), ("past", "1", 4, None, "x", False, False, "no-such-line"),
            ("zero", "1", 0, None, "alpha", False, False, "no-such-line"), ("run", "1", 1, 3, "gamma delta", False, False, None),
            ("run-verbatim", "1", 1, 2, "alpha  beta", True, False, "verbatim-but-joined"), ("run-past", "1", 2, 9, "x", False, False, "no-such-line"),
            ("field", "1", None, None, "gamma\ndelta", False, False, None), ("field-lines", "1", None, None, "gamma\ndelta", True, False, "verbatim-spans-lines"),
            ("joined", "2", 1, None, "one", True, False, "verbatim-but-joined"), ("joined-ok", "2", 1, None, "one", False, False, None),
            ("null-body", "3", 1, None, "x", False, False, "no-such-line"), ("no-row", "9", 1, None, "x", False, False, "no-such-line")]
    claims = spark.createDataFrame([(c, "d", k, "text", n, m, t, v, e) for c, k, n, m, t, v, e, _ in told], CLAIM)
    assert {r.claim_id: r.reason for r in resolve_anchors(claims, texts).collect()} == {c[0]: c[-1] for c in told if c[-1]}


def test_many_claims_of_one_line(spark):
    n = 3 * CLAIMS
    texts = spark.createDataFrame([("d", "1", "text", "alpha\nbeta", False)], "family string, key string, field string, body string, joined boolean")
    claims = spark.range(n).select(F.concat(F.lit("c"), "id").alias("claim_id"), F.lit("d").alias("family"), F.lit("1").alias("key"),
                                   F.lit("text").alias("field"), F.lit(1).cast("long").alias("line_no"), F.lit(None).cast("long").alias("line_to"),
                                   F.when(F.col("id") % 100 == 0, "beta").otherwise("alpha").alias("text"), F.lit(True).alias("verbatim"), F.lit(True).alias("exact"))
    assert resolve_anchors(claims, texts).count() == n // 100


def test_plan_moves_a_text_once(spark):
    texts = spark.createDataFrame([("d", "1", "text", "alpha", False)], "family string, key string, field string, body string, joined boolean")
    claims = spark.createDataFrame([("c", "d", "1", "text", 1, None, "alpha", True, True)], CLAIM)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = resolve_anchors(claims, texts)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == 2 and "Aggregate" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_posting_deltas_of_odd_ids(spark, tmp_path):
    """Repeated, null and negative ids, lists over many blocks; texts move once and postings only as lists."""
    import duckdb
    from spanledger.plans import catalog
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 5, 5000]) if rnd.random() < .1 else rnd.randrange(-3000, 9000), " ".join(rnd.choices(["Aa", "bb", "cc", f"w{i}", "x"], k=4)))
            for i in range(500)] + [(7, None), (8, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["posting_deltas"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["posting_deltas"](spark, str(tmp_path)).select("token", "doc_id", "delta", "decoded").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 1000
