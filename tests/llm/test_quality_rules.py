import pyarrow.parquet as pq
from pyspark.sql import functions as F

from spanledger.llm.quality_rules import RULES, cascade, ordered
from spanledger.llm.queries import ORACLES, QUERIES
from tests.llm.brute import words
from tools.compare import compare, connect

SF = "/root/testdata/sf0.01"


def statistics(text):
    w, t = words(text), text or ""
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    often = {g for g in grams if grams.count(g) > 1}
    covered = {j for i, g in enumerate(grams) if g in often for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_against_sql(spark):
    got = QUERIES["op8_quality_rules"](spark, SF).toPandas()
    assert compare(got, connect(SF).execute(ORACLES["op8_quality_rules"]).fetchdf()) == "ok"


def test_keeps_good_and_drops_bad(spark):
    got = {r.doc_id: r for r in QUERIES["op8_quality_rules"](spark, SF).collect()}
    labels = [x for x in pq.read_table(f"{SF}/labels.parquet").to_pylist() if not got[x["doc_id"]].base_failed]
    good = [got[x["doc_id"]].kept for x in labels if x["quality"] == 1]
    bad = [got[x["doc_id"]].kept for x in labels if x["quality"] == 0]
    print(sum(good) / len(good), sum(bad) / len(bad), len(bad))
    assert sum(good) > .97 * len(good)


ODD = [None, "", " \n\t", "a " * 19, "w%d " * 3, " ".join(map(str, range(30))), "x y z w v u t s r q " * 4, "a b c d e f g h\n" * 2 + "i j k l m n o p q r s t u",
       "é" * 50000, "line one\nline one\n\n \nLine one", "a b c d e f g h a b c d e f g h", "# * $ % & | < >"]


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, t, 5, True) for i, t in enumerate(ODD)] + [(3, ODD[3], 5, True)], "doc_id long, text string, n_words int, kept boolean")
    rows = cascade(df).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == statistics(r.text), r.doc_id
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert cascade(df.limit(0)).collect() == []


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, t, 1, "x", i) for i, t in enumerate(ODD)], "doc_id long, _text string, _words int, _lines string, _RUNS int")
    got = cascade(df, text="_text").collect()
    plain = cascade(df.select("doc_id", F.col("_text").alias("text"))).collect()
    assert got[0].asDict().keys() >= {"_text", "_words", "_lines", "_RUNS", "kept"}
    assert [(r.doc_id, r["_text"], r["_words"], r["_lines"], r["_RUNS"]) for r in got] == [(i, t, 1, "x", i) for i, t in enumerate(ODD)]
    assert sorted((r.doc_id, r.n_repeat_words, r.kept) for r in got) == sorted((r.doc_id, r.n_repeat_words, r.kept) for r in plain)


def test_costs_are_told_from_an_idle_job(spark):
    """A rule with far more to do costs more, whichever comes first in the list; of rules that reject nothing the cheaper goes first."""
    from spanledger.llm.quality_rules import Rule, measured, with_statistics
    df = spark.createDataFrame([(i, "plain word " * 300) for i in range(200)], "doc_id long, text string")
    dear, cheap = Rule("dear", "length(regexp_replace(_text, '[a-z]+ ', 'b')) < 0"), Rule("cheap", "n_words < 0")
    sample = with_statistics(df).select("_text", "n_words").cache()
    for rules in ((dear, cheap), (cheap, dear)):
        told = measured(sample, rules)
        assert told["dear"][0] > 3 * told["cheap"][0] and told["dear"][1] == told["cheap"][1] == 0
        assert [r.name for r in ordered(sample, rules)] == ["cheap", "dear"]


def test_order_is_by_worth_and_changes_no_verdict(spark):
    df = spark.createDataFrame([(i, "word% " * 30 if i % 2 else "plain word " * 30) for i in range(50)], "doc_id long, text string")
    from spanledger.llm.quality_rules import with_statistics
    assert ordered(with_statistics(df), RULES)[0].name == "symbols"
    assert {tuple(r) for r in cascade(df, RULES[::-1]).collect()} == {tuple(r) for r in cascade(df).collect()}
