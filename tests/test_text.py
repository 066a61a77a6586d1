import html

import pytest
from pyspark.sql import functions as F

from spanledger.functions import text as T
from spanledger.functions import words as W
from spanledger.operators import lines as L


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text,want", [
    ("a  b\tc", ["a", "b", "c"]), ("say \"two words\" now", ["say", "\"two words\"", "now"]),
    ("don't stop here", ["don't stop here"]), ("x'a b'y z", ["x'a b'y", "z"]), ("", []), ("a b", ["a", "b"]),
])
def test_tokens(spark, text, want):
    assert one(spark, text, T.tokens) == want


@pytest.mark.parametrize("text,want", [
    ("a | b && c || d ; e", ["a", "b", "c", "d", "e"]), ("a & b", ["a & b"]), ("echo 'x | y' | z", ["echo 'x | y'", "z"]),
    ("stat $(ls -d /x | head -1) | wc", ["stat $(ls -d /x | head -1)", "wc"]), ("a `b | c` ; d", ["a `b | c`", "d"]),
    (" | a", ["a"]), ("a $(b $(c | d) | e) && f", ["a $(b $(c | d) | e)", "f"]),
])
def test_stages(spark, text, want):
    assert one(spark, text, T.stages) == want


@pytest.mark.parametrize("text,want", [
    ("sudo -u bob dnf install x", "dnf"), ("sudo -i", "sudo"), ("sudo", "sudo"), ("FOO=1 BAR=2 gsettings list", "gsettings"),
    ("FOO=1", ""), ("timeout -k 3 5 /usr/bin/ls -l", "/usr/bin/ls"), ("xargs -n 1 -- rm -f", "rm"),
    ("/usr/bin/sudo nohup tar x", "tar"), ("env A=1 ls", "env"), ("sudo -s ls", "sudo"), ("timeout 5", "timeout"),
    ("sudo FOO=1 ls", "ls"),
])
def test_command_head(spark, text, want):
    assert one(spark, text, T.command_head) == want


@pytest.mark.parametrize("text,want", [
    ("The user must be able to do this", True), ("dnf install the thing --now", False), ("cat the of", False),
    ("one two three four", False), ("look at the file in /etc/x", False),
])
def test_prose(spark, text, want):
    assert one(spark, text, lambda c: T.prose_like(T.tokens(c))) is want


@pytest.mark.parametrize("text,want", [
    ("has old configurations. They stay", True), ("dig ipa.example.com. NS", False),
    ("shutdown \"Attention. The system\"", False), ("é.ab. Then", False), ("so ab. Then", True),
])
def test_sentence(spark, text, want):
    assert one(spark, text, T.sentence_like) is want


@pytest.mark.parametrize("text,want", [
    ("echo \"a", True), ("podman run --template", True), ("dnf upgrade --all", False), ("x -", True), ("a=", True),
    ("ls -l", False), ("", False), ("ls --color=auto", False),
])
def test_truncated(spark, text, want):
    assert one(spark, text, T.looks_truncated) is want


def test_invisible_characters_each_range_and_escape(spark):
    rows = [(i, "ok " + chr(a) + chr(b)) for i, (a, b) in enumerate(W.INVISIBLE_RANGES)]
    rows += [(100, "tab\tlf\ncr\r"), (101, chr(0xFEFF) + "leading mark"), (102, "x" + chr(0xFEFF))]
    df = spark.createDataFrame(rows, "id int, t string")
    hit = {r.id for r in L.invisible_hits(df, "id", "t").collect()}
    assert hit == set(range(len(W.INVISIBLE_RANGES))) | {102}
    got = {r.id: r.x for r in df.select("id", T.escape_invisible(F.col("t")).alias("x")).collect()}
    assert got[100] == "tab\tlf\ncr\r" and got[102] == "x\\uFEFF"


@pytest.mark.parametrize("text", [
    "&lt;a&gt; &amp;lt; &#65;&#x1F600; &copy 2020 &notit; &bogus; &#150; &#0; &#xD800; plain", "no references", "&", "&&amp;",
])
def test_unescape_is_the_html_rule(spark, text):
    assert one(spark, text, T.unescape_html) == html.unescape(text)


def test_clean_markup_and_cap(spark):
    assert one(spark, " <b>x</b>\r\n\r\n\r\n\r\ny&amp; ", T.clean_markup) == "x\n\ny&"
    assert one(spark, "aaa\nbbb\nccc", lambda c: T.cap_at_line(c, 8, "[cut]")) == "aaa\nbbb[cut]"
    assert one(spark, "aaa", lambda c: T.cap_at_line(c, 8, "[cut]")) == "aaa"


ODD_PAGES = [
    "<p>token = &quotp{margin:0}</p>", "&quot &lt &gt; &nbsp &copy 2020 &middot &apos; &#39; &#39 &#x27;", "&eacute; &hellip; &#65; &#150; &notit;",
    "&amp;lt; &amplt; &amp;amp; &ampamp; &AMP; &&amp", "<>a<b\n>c< d", "a\r\n\r\n\r\nb\r\r\n\n\n\n", "\x1c\x85\u3000 x \u2003", "\xa0\t\x0b y &nbsp;\r",
    "&nbsp;<i>z</i>&#160;", "", " ", "<only>", None]


def test_markup_clean_is_its_sql(spark, tmp_path):
    """Whatever references, spaces and nulls the pages hold."""
    import duckdb

    from spanledger.plans import catalog
    spark.createDataFrame(list(enumerate(ODD_PAGES)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["markup_clean"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["markup_clean"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) == len(ODD_PAGES)


def test_names_and_titles(spark):
    assert one(spark, " Ann  Lee (QA) ", T.normal_name) == "ann lee"
    assert one(spark, "using_the tools and files", T.title_case) == "Using the Tools and Files"


def test_prompts(spark):
    rows = [("$ ls",), ("#  id -u ",), ("#find / x",), ("#!bin",), ("$ls",), ("plain",)]
    got = [(r.prompt, r.command) for r in L.with_prompt(spark.createDataFrame(rows, "line string")).collect()]
    assert got == [("$", "ls"), ("#", "id -u"), ("#", "find / x"), ("", ""), ("", ""), ("", "")]


def test_text_tables_are_dealt_to_all_tasks(spark):
    """A file of one row group is worked on by as many tasks as a shuffle has, without a setting of its own."""
    from spanledger.plans.base import texts
    spread = spark.conf.get("spark.spanledger.spread")
    spark.conf.unset("spark.spanledger.spread")
    try:
        assert texts(spark, "/root/testdata/sf0.001", "part").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.spanledger.spread", spread)


def test_keys_are_counted_in_partitions_that_stay(spark):
    """Packed keys are not joined to one partition, whose task would hold them all; XML is read once for all rules."""
    from spanledger.operators.integrity import duplicate_keys
    from spanledger.plans.source_plans import xml_violations
    rows = spark.range(3000).selectExpr("if(id < 1000, 7, id) as a", "if(id % 2 = 5, 'x', null) as b")
    got = duplicate_keys(rows, "a", "b")
    assert [tuple(r) for r in got.collect()] == [(7, None, 1000)]
    assert got.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    plan = xml_violations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "from_xml" not in plan
