import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from spanledger.llm.ordinal import fit, graded
from spanledger.llm.queries import QUERIES
from spanledger.llm.toxicity import NOISY, Restorer, language_model, restored, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labels():
    return {r["doc_id"]: r for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}


def share(pairs):
    return sum(a == b for a, b in pairs) / len(pairs)


def test_toxicity_on_held_out_rows(spark, labels):
    rows = QUERIES["op10_toxicity"](spark, SF).collect()
    assert len(rows) == pq.read_metadata(f"{SF}/documents.parquet").num_rows
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= .3) and 0 <= r.score <= 1 for r in rows)
    test = [(r.predicted, labels[r.doc_id]["toxic"]) for r in rows if r.held_out and r.doc_id in labels]
    found = [p for p, y in test if y]
    print("toxic found", sum(found) / len(found), "right", share(test))
    assert share(test) > .95


def test_grades_on_all_rows(spark, labels):
    rows = QUERIES["op7_quality_grade"](spark, SF).collect()
    test = [(int(r.kept), labels[r.doc_id]["quality"]) for r in rows if r.doc_id in labels]
    kept = [p for p, y in test if y]
    print("good kept", sum(kept) / len(kept), "right", share(test))
    assert share(test) > .93 and sum(kept) > .97 * len(kept)


def test_thresholds_are_ordered_and_found():
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 2, (4000, 3))
    s = x @ [2.0, -1.0, 0.5] + rnd.logistic(size=4000)
    grade = (s > 0).astype(int) + (s > 1.5)
    row, column = np.nonzero(x)
    w, t = fit(grade, row, column, 3, 3)
    assert t[0] < t[1] and abs(t[1] - t[0] - 1.5) < .3 and np.abs(w - [2, -1, .5]).max() < .35


def test_obfuscated_words_are_restored(spark):
    docs = spark.createDataFrame([(i, "an idiot and a moron said stupid trash to the loser " * 3) for i in range(50)], "doc_id long, text string")
    model = language_model(docs)
    for noisy, plain in (("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("l.o.s.e.r", "loser"), ("t r a s h", "trash"), ("$tup1d", "stupid")):
        assert NOISY.search(f"say {noisy} now".encode())[0].decode() == noisy
        assert restored(noisy, model) == plain


def test_spaced_words_are_told_apart(spark):
    docs = spark.createDataFrame([(i, "you idiot said that a loser and a moron are trash to you " * 3) for i in range(50)], "doc_id long, text string")
    model = language_model(docs)
    for noisy, plain in (("a t r a s h", "a trash"), ("y o u i d i o t", "you idiot"), ("1 d 1 0 t", "idiot"), ("l 0 s e r", "loser"), ("y.o.u.m.0.r.0.n", "you moron")):
        assert NOISY.search(f"say {noisy}! now".encode())[0].decode().rstrip("!") == noisy
        assert restored(noisy, model) == plain


def test_no_noisy_token_is_passed_over(spark):
    docs = spark.createDataFrame([(i, "a worthless pathetic disgusting loser and idiot said scheiße to you all day long " * 3) for i in range(50)], "doc_id long, text string")
    restorer = Restorer(language_model(docs))
    whole = "a worthless pathetic disgusting loser and idiot said"
    for noisy, plain in (("l053r", "loser"), ("w0r7hl355", "worthless"), ("p47h371c", "pathetic"), ("d15gu571ng", "disgusting"),
                         ("idi@t.", "idiat"), ("sch3iße", "scheiße"), (" ".join(whole.replace(" ", "")), whole)):
        text = f"say {noisy} now".encode()
        assert restorer.text(text)[len(text) + 1:].decode() == plain
    assert b"idiot" in restorer.text(b"say !d!ot now").split()
    assert restorer.text(b"write to me@home.org or https://a1b.org/c2d") == b"write to me@home.org or https://a1b.org/c2d"


def test_obfuscation_is_scored(spark):
    bad = ["idiot", "moron", "loser"]
    docs = [(i, f"the report of day {'x' * (i % 7)} was {bad[i % 3] if i % 2 else 'fine'} and the rest of it was read") for i in range(400)]
    more = [(1000, "the report was 1d10t and the rest"), (1001, "the report was l.o.s.e.r and the rest"), (1002, "the report was fine and the rest"), (1003, None), (1004, "")]
    df = spark.createDataFrame([(*d, 1) for d in docs + more], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity(df, labels).collect()}
    assert [got[i] for i in range(1000, 1003)] == [1, 1, 0] and {1003, 1004} <= got.keys()


def test_all_labelled_rows_are_fitted(spark):
    """A fit by tasks takes all rows and ends where the fit by the driver does."""
    bad = ["idiot", "moron", "loser", "clown", "fool"]
    docs = [(i, f"the report of day {'x' * (i % 7)} was {bad[i % 5] if i % 2 else 'fine'} and the rest of it was read") for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    toxic = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    grades = spark.createDataFrame([(i, i % 2 * (1 + i % 5 // 3)) for i, _ in docs], "doc_id long, grade int")
    for fitted, column in ((lambda rows: toxicity(df, toxic, rows), "score"), (lambda rows: graded(df, grades, rows=rows), "expected_grade")):
        few, whole = [{r.doc_id: r[column] for r in fitted(rows).collect()} for rows in (6, 10 ** 6)]
        assert max(abs(few[i] - whole[i]) for i in few) < 0.1 and max(whole.values()) > 0.8


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "a", 1), (2, "é" * 100000, 1), (3, "a.b " * 20000, 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, toxic int, quality int")
    ratings = labels.selectExpr("doc_id", "quality as grade")
    assert len(toxicity(df, labels).collect()) == len(graded(df, ratings).collect()) == 5
    assert len(toxicity(df, labels.limit(0)).collect()) == len(graded(df, ratings.limit(0)).collect()) == 5
    assert toxicity(df.limit(0), labels).collect() == graded(df.limit(0), ratings).collect() == []


def test_only_texts_with_a_grade_are_moved(spark):
    """The plan is the same for few grades as for many, and texts without a grade are left out before the shuffle."""
    from spanledger.llm.text_features import perhaps_in, training_rows
    docs = spark.range(0, 40_000, 1, 4).selectExpr("if(id = 7, null, id * 1000003) as doc_id", "if(id = 30, null, concat('text ', id)) as text")
    ids = spark.range(0, 40_000, 10, 4).selectExpr("id * 1000003 as doc_id")
    near = perhaps_in(docs, ids, "doc_id")
    assert ids.join(near, "doc_id", "left_anti").count() == 0 and 4000 <= near.count() < 4000 + 36_000 // 6
    assert perhaps_in(docs, ids.limit(0), "doc_id").count() == 0
    told = training_rows(docs, ids.selectExpr("doc_id", "cast(doc_id % 2 as int) as grade").union(spark.createDataFrame([(10 * 1000003, 5), (None, 1)], "doc_id long, grade int")))
    assert "SortMergeJoin" in told._jdf.queryExecution().executedPlan().toString()
    rows = {r.text: r.grade for r in told.collect()}
    assert len(rows) == told.count() == 4000 and rows["text 10"] == 5 and "" in rows and rows["text 20"] == 0


def test_every_telling_word_weighs(spark):
    """More words tell the label than a model of a fixed size would hold: each of them has a weight."""
    from spanledger.llm import text_features as X
    words = ["".join(chr(97 + i // 26 ** k % 26) for k in range(4)) for i in range(0, 26 ** 4, 100)]
    texts = [(" ".join(words[j:j + 10]) if i % 2 else "the report of today was read", i % 2) for j in range(0, len(words), 10) for i in range(24)]
    told = X.choose(spark.createDataFrame(texts, "text string, grade long"), X.words_and_stems, 2)
    own = [X.words_and_stems(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[1] for w in words]
    assert len(words) == 4570 and all(np.isin(f, told).all() for f in own)
    common = X.words_and_stems(np.frombuffer(b"report", np.uint8), np.array([0, 6]))[1]
    assert np.isin(common, told).all() and not len(X.choose(spark.createDataFrame([("a b", 0), ("a b", 1)], "text string, grade long"), X.words_and_stems, 2))
