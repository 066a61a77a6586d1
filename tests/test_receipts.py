"""Receipts as JSON texts, documentation markup and slugs."""

import hashlib
import json

from pyspark.sql import functions as F

from spanledger.functions import text as T
from spanledger.operators.receipts import RECEIPT_FIELDS, receipt_text_violations


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def receipt(**over):
    r = {f: "x" for f in RECEIPT_FIELDS}
    r |= {"schema": "receipt/1", "rhel_version": "9", "executed_at": "2024-01-01T10:00:00+02:00", "command": "ls", "command_sha256": sha("ls"), "artifact_sha256": sha("a"),
          "content_fingerprint": sha("f"), "exit_code": 0, "stdout": "é", "stdout_sha256": sha("é"), "stderr": "", "stderr_sha256": sha(""),
          "attestation": {"command_was_executed": True, "outputs_are_actual": True, "statement": "s"}}
    r |= over
    return json.dumps({k: v for k, v in r.items() if v is not ...})


def test_each_rule_alone(spark):
    whole = {"command_was_executed": True, "outputs_are_actual": True, "statement": "s"}
    cases = {"": receipt(), "undeclared-zz": receipt(zz=1), "missing-ticket": receipt(ticket=...), "schema": receipt(schema="other"), "empty-target": receipt(target=" "),
             "release": receipt(rhel_version="6"), "timestamp-zone": receipt(executed_at="2024-01-01T10:00:00"), "exit-code": receipt(exit_code="no"),
             "digest-form-artifact_sha256": receipt(artifact_sha256=sha("a").upper()), "digest-command": receipt(command="rm"), "digest-stdout": receipt(stdout="e"),
             "undeclared-attestation-more": receipt(attestation=whole | {"more": 1}), "not-executed": receipt(attestation=whole | {"command_was_executed": False}),
             "outputs-not-actual": receipt(attestation=whole | {"outputs_are_actual": None}), "no-statement": receipt(attestation=whole | {"statement": ""}),
             "not-an-object": "{nope"}
    d = spark.createDataFrame([(k or "sound", v) for k, v in cases.items()], "k string, body string")
    got = sorted(map(tuple, receipt_text_violations(d, "k", "body", "receipt/1").collect()))
    assert got == sorted((k, k) for k in cases if k)
    several = spark.createDataFrame([("a", receipt(ticket=..., zz=1, command="rm")), ("b", None)], "k string, body string")
    assert sorted(map(tuple, receipt_text_violations(several, "k", "body", "receipt/1").collect())) == [
        ("a", "missing-ticket"), ("a", "undeclared-zz"), ("b", "not-an-object")]


def test_markup_and_slug(spark):
    d = spark.createDataFrame([(" use I(name) of C(x y), R(the guide, sec) at U(http://a) L(b) M() ", "rhel.txt"), ("plain (text)", "a.txt.gz")], "t string, n string")
    rows = d.select(T.strip_doc_markup(F.col("t")).alias("t"), T.guide_slug(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in rows] == [("use name of x y, the guide at http://a b", "rhel"), ("plain (text)", "a.txt.gz")]
