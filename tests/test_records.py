"""The chain from judged lines to the record table, and the ledger over what was written."""

import pytest
from pyspark.sql import functions as F

from spanledger.operators import records as R

KINDS = "family string, release string, text string, tool string, reason string, governing boolean, verbatim_span boolean"
CUT = 'echo "open'


@pytest.fixture()
def judged(spark):
    rows = [("log", "8", "rm -rf /srv | grep x", "rm", None, False, True)] * 3 + [
        ("docs", "10", "rm -rf /srv | grep x", "rm", None, True, False), ("docs", "9", "ls -l", "ls", None, True, True),
        ("log", "8", CUT, "echo", None, False, True), ("log", "8", "a sentence.", None, "prose", False, True),
        ("log", "9", "odd", None, "unparseable", False, True)]
    return spark.createDataFrame(rows, KINDS)


def ledger_rows(df):
    return sorted(tuple(r) for r in df.select(
        "family", "release", "candidates", "classified", "residue", "recorded", "records", "unclassified_residue", "residue_recount").collect())


def codes(df):
    return sorted((r.family, r.release, r.code) for r in R.imbalances(df).collect())


def test_records_are_finalised(judged):
    rows = R.Mined(judged).records.collect()
    assert [r.tool for r in rows] == ["echo", "ls", "rm"]
    echo, ls, rm = rows
    assert rm.n == 4 and rm.authority == "governing" and not rm.verbatim_span and rm.stages == ["rm", "grep"] and rm.rating == "red"
    assert rm.releases == ["8", "10"] and [tuple(c) for c in rm.cells] == [("docs", "10", 1), ("log", "8", 3)]
    assert ls.stages is None and ls.rating == "unrated" and ls.verbatim_span
    assert echo.truncated and not echo.verbatim_span and echo.authority == "documentary"


def test_ledger_of_an_intact_run(judged):
    m = R.Mined(judged)
    assert m.observed == {"lines": 8, "taken": 6}
    ledger = R.audit(judged.select("family", "release"), m.judged, m.records, m.residue)
    assert ledger_rows(ledger) == [("docs", "10", 1, 1, 0, 1, 1, 0, 0), ("docs", "9", 1, 1, 0, 1, 1, 0, 0),
                                   ("log", "8", 5, 4, 1, 4, 2, 0, 1), ("log", "9", 1, 0, 1, 0, 0, 1, 1)]
    assert codes(ledger) == [("log", "9", "zero-classified")]


def test_each_loss_is_found(judged):
    m, source = R.Mined(judged), judged.select("family", "release")
    ls = F.col("tool") == "ls"
    known = [("log", "9", "zero-classified")]
    # A row that is gone from the written table.
    assert codes(R.audit(source, m.judged, m.records.where(~ls), m.residue)) == [("docs", "9", "recorded"), *known]
    # A citation lost inside a record.
    fewer = m.records.withColumn("cells", F.filter("cells", lambda c: c["release"] != "10"))
    assert codes(R.audit(source, m.judged, fewer, m.residue)) == [("docs", "10", "recorded"), *known]
    # A judged line that never was in the source, one that was never judged, and a lost residue row.
    assert ("docs", "9", "cell-not-in-source") in codes(R.audit(source.where("release <> '9'"), m.judged, m.records, m.residue))
    assert codes(R.audit(source.union(source.where("release = '10'")), m.judged, m.records, m.residue)) == [("docs", "10", "candidates"), *known]
    assert ("log", "8", "recount") in codes(R.audit(source, m.judged, m.records, m.residue.where("text <> 'a sentence.'")))


def test_nothing_taken(judged):
    m = R.Mined(judged.where("false"))
    assert m.records.count() == 0 and R.audit(judged.select("family", "release").where("false"), m.judged, m.records, m.residue).count() == 0
