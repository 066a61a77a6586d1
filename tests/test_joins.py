from pyspark.sql import functions as F

from spanledger.operators import integrity as I
from spanledger.operators import joins as J
from spanledger.operators import ledger as G
from spanledger.operators.overlap import governed_texts, ngram_overlap


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_pointer_chains(spark):
    chain = [(i, i + 1) for i in range(100, 400)] + [(400, None)]
    data = [(1, 2), (2, 3), (3, 4), (4, None), (5, 6), (6, 5), (7, 99), (8, 5), (9, 9)] + chain
    got = {r.node: (r.status, r.target, r.hops) for r in J.resolve_pointers(
        spark.createDataFrame(data, "node long, same_as long")).collect()}
    assert got[1] == ("ok", 4, 3) and got[4] == ("ok", 4, 0) and got[7] == ("dangling", 99, 1)
    assert all(got[n] == ("cycle", None, -1) for n in (5, 6, 8, 9))
    assert got[100] == ("ok", 400, 300) and len(got) == len(data)


def test_eight_words_fire_and_seven_do_not(spark):
    w = [f"w{i}" for i in range(40)]
    prot = spark.createDataFrame([(" ".join(w),)], "t string")
    texts = spark.createDataFrame([(7, "x " + " ".join(w[3:10]) + " y"), (8, "x " + " ".join(w[3:11]) + " y"),
                                   (9, "W3, w4!\nw5  w6 w7 w8 w9 W10 w3 w4")], "id long, t string")
    gram = " ".join(w[3:11])
    got = rows(ngram_overlap(texts, "id", "t", prot, "t"), "id", "shared_grams", "first_gram")
    assert got == [(8, 1, gram), (9, 1, gram)]


def test_field_licence_wins(spark):
    d = spark.createDataFrame([(1, "paraphrase-only", "verbatim-ok"), (2, None, "paraphrase-only"),
                               (3, "verbatim-ok", "paraphrase-only"), (4, None, None)],
                              "id int, field_license string, row_license string")
    assert rows(governed_texts(d), "id") == [(1,), (2,)]


def test_ties(spark):
    d = spark.createDataFrame([("a", 2, 5, "x"), ("a", 2, 3, "y"), ("a", 1, 1, "z")], "k string, rev int, pos int, v string")
    best = J.best_per_key(d, ["k"], F.col("rev"), -F.col("pos"), keep=["v"])
    assert rows(best, "k", "v") == [("a", "y")]
    assert rows(J.first_per_key(d, ["k"], F.col("rev"), keep=["v"]), "k", "v") == [("a", "z")]


def test_fk_and_empty_parent(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c"), (3, "z")], "k int, v string")
    parent = spark.createDataFrame([(1, "a"), (3, "c")], "k int, v string")
    got = rows(I.fk_violations(child, "k", parent, "k", "c", [("v", "v")]), "code", "key", "n")
    assert got == [("attribute-v", "3", 1), ("unresolved", "2", 2)]
    assert I.fk_violations(child.limit(0), "k", parent, "k", "c").count() == 0


def test_merge_keeps_curated_text_and_vanished_rows(spark):
    old = spark.createDataFrame([("a", "why", None), ("b", "gone", None), ("c", "older", "8")], "k string, explain string, removed_in string")
    new = spark.createDataFrame([("a",), ("d",)], "k string")
    got = rows(J.merge_curated(old, new, ["k"], ["explain"], "10"), "k", "explain", "removed_in", "state")
    assert got == [("a", "why", None, "kept"), ("b", "gone", "10", "removed"), ("c", "older", "8", "removed"), ("d", None, None, "new")]


def test_merge_carries_all_columns(spark):
    old = spark.createDataFrame([("a", "", "p1", 1, None), ("b", "gone", "p2", 2, None)],
                                "k string, explain string, page string, seen int, removed_in string")
    new = spark.createDataFrame([("a", "fresh", "q1", True), ("d", "new", "q4", False)], "k string, explain string, page string, takes_arg boolean")
    got = {r.k: (r.explain, r.page, r.takes_arg, r.seen, r.state) for r in J.merge_curated(old, new, ["k"], ["explain"], "10").collect()}
    assert got == {"a": ("fresh", "q1", True, 1, "kept"), "b": ("gone", "p2", None, 2, "removed"), "d": ("new", "q4", False, None, "new")}


def test_fingerprint_text_tells_rows_apart(spark):
    from spanledger.functions.hashing import canonical_text
    texts = [("\\N", "x", 0.0), (None, "x", 0.0), ("a", "b=1:c", 1e-12), ("a", "b", 1e30), ("a", "b", float("nan")),
             ("a1:b", "", -0.0), ("a", "\x1f", 1e300), ("-", None, 0.0)]
    d = spark.createDataFrame(texts, "a string, b string, c double")
    assert d.select(canonical_text(d).alias("t")).distinct().count() == len(texts)


def test_index_finds_what_a_scan_finds(spark):
    from spanledger.operators import search as S
    frame = spark.createDataFrame([("k", "1", "Part #77 a"), ("k", "2", "part 77"), ("k", "3", "x a b"), ("k", "4", "!! ##")],
                                  "kind string, id string, t string").select("kind", "id", F.lower("t").alias("hay"))
    queries = ["part #77", "a", "##", "art 7", "none"]
    got = rows(S.index_search(S.postings(frame, "id", "hay", "kind", min_len=1), frame, queries, ["kind", "id"]), "query", "id")
    hay = {r.id: r.hay for r in frame.collect()}
    assert got == sorted((q, i) for q in queries for i, h in hay.items() if all(t in h for t in q.split()))


def test_ratchet_statuses(spark):
    cur = spark.createDataFrame([("a", 5), ("b", 5), ("c", 3), ("d", 5), ("e", 5), ("n", 1), ("o", 1)], "k string, v long")
    base = spark.createDataFrame([("a", 5, "o", "2027-01-01"), ("b", 4, "o", "2027-01-01"), ("c", 4, "o", "2027-01-01"),
                                  ("d", 9, "o", "2020-01-01"), ("e", 9, None, "2027-01-01"), ("m", 9, "o", "2027-01-01"),
                                  ("o", 9, "o", "soon")], "k string, cap long, owner string, retire_by string")
    got = dict(rows(G.ratchet(cur, base, ["k"], "v", "cap", "2026-09-17"), "k", "status"))
    assert got == {"a": "held", "b": "grew", "c": "improved", "d": "expired", "e": "no-owner", "m": "missing-row",
                   "n": "new-cell", "o": "bad-date"}
