import pytest

from spanledger.operators.mining import mine

LINES = [
    ("$ dnf install x", "dnf", None), ("# dnf update", "dnf", None), ("# FOO=1 dnf x", None, "config-fragment"),
    ("# for f in x", None, "unparseable"), ("# the end of it", None, "prose"), ("# device {", None, "config-fragment"),
    ("# bash -c 'x'", None, "unparseable"), ("# keep these values", None, "prose"), ("# podman run", None, "binary-not-on-release"),
    ("Select it from the menu", None, "interactive-tui"), ("-w /etc/passwd -p wa", None, "config-fragment"),
    ("12:04 host", None, "output-fragment"), ("## banner", None, "config-fragment"), ("# Ab. Then Cd ef. Xy", None, "prose"),
    ("# /usr/sbin/odd thing", "odd", None), ("# retry = 3", None, "config-fragment"), ("$ podman ps", None, "binary-not-on-release"),
]


def test_cascade_reaches_every_reason(spark):
    df = spark.createDataFrame([("f", "8", i, t) for i, (t, _, _) in enumerate(LINES)],
                               "family string, release string, n int, line string")
    absent = spark.createDataFrame([("8", "podman")], "release string, head string")
    got = {r.n: (r.tool, r.reason) for r in mine(df, absent).collect()}
    assert got == {i: (tool, reason) for i, (_, tool, reason) in enumerate(LINES)}


@pytest.mark.parametrize("policy,want", [("vocabulary", "unparseable"), ("lowercase", None)])
def test_policies_differ_on_evidence_without_vocabulary(spark, policy, want):
    df = spark.createDataFrame([("f", "8", 1, "# zork --now"), ("f", "8", 2, "# zork it")],
                               "family string, release string, n int, line string")
    absent = spark.createDataFrame([], "release string, head string")
    got = {r.n: r.reason for r in mine(df, absent, policy=policy).collect()}
    assert got[2] == want


def test_command_token_of_any_length(spark):
    import re

    from spanledger.functions import text as T
    plain = re.compile(r"^(/[A-Za-z0-9_.+-]+)*/?[A-Za-z0-9_][A-Za-z0-9_.+-]*$")
    short = ["a", "/a", "/", "//a", "/a//b", "/a/", "a/b", "/-x", "/x/-", "/x/-y", "-x", ".x", "/.", "/..a", "", "/a/b.c", "a+b", "/a b", "é", "/a/é"]
    rows = spark.createDataFrame([(t,) for t in short], "t string").selectExpr("t", f"t rlike r'{T.COMMAND_TOKEN}' as ok").collect()
    assert {r.t: r.ok for r in rows} == {t: bool(plain.search(t)) for t in short}
    long = spark.createDataFrame([("/x" * 100_000,), ("/x" * 100_000 + "/.",), ("x" * 200_000,)], "t string")
    for pattern in (T.COMMAND_TOKEN, T.LOWER_BASENAME, T.ENV_ASSIGN, T.PLAIN_WORD, T.PROMPT, T.TIGHT_PROMPT, T.CONFIG_LINE, T.BLOCK_OPENER,
                    T.EVIDENCE_TOKEN, T.QUOTED_RUN, T.SENTENCE_BOUNDARY):
        long.select(long.t.rlike(pattern)).collect()
    assert [r[0] for r in long.select(long.t.rlike(T.COMMAND_TOKEN)).collect()] == [True, False, True]
