"""Stages and operators of command lines with substitutions of any depth."""

import random

from pyspark.sql import functions as F

from spanledger.functions import text as T
from spanledger.operators.census import top_level_operators


def column(spark, texts, fn):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fn(F.col("t")).alias("o"))
    return [r.o for r in sorted(d.collect(), key=lambda r: r.i)]


def plain_stages(text):
    """Character by character: an open quote hides all, else depth decides."""
    out, word, quote, depth, i = [], "", "", 0, 0
    while i < len(text):
        two, c = text[i:i + 2], text[i]
        size = 1
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "`":
            depth = 1 if not depth else depth - 1
        elif two == "$(":
            depth, size = depth + 1, 2
        elif depth and c in "()":
            depth += 1 if c == "(" else -1
        elif not depth and (two in ("||", "&&") or c in "|;\n"):
            out.append(word)
            word, i = "", i + (2 if two in ("||", "&&") else 1)
            continue
        word, i = word + text[i:i + size], i + size
    return [s for s in (x.strip() for x in [*out, word]) if s]


def test_random_lines(spark):
    rnd = random.Random(9)
    parts = ["$(", "(", ")", "`", "'", '"', "|", "||", "&&", "&", ";", "\n", "$", " ", "ls", "x y", "$((", "2>&1"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(1500)]
    texts += [t.replace("$(", "").replace("`", "") for t in texts]
    want = [plain_stages(t) for t in texts]
    assert column(spark, texts, T.stages) == want
    assert column(spark, texts, T.first_stage) == [w[0] if w else "" for w in want]


def test_ten_levels_deep(spark):
    deep = "a"
    for i in range(10):
        deep = f"h{i} $( {deep} | b; (c && d) )"
    texts = [f"{deep} | tail ; end", f"echo {deep} && `x | y` || z", deep[:-30]]
    assert column(spark, texts, T.stages) == [[deep, "tail", "end"], [f"echo {deep}", "`x | y`", "z"], [deep[:-30]]]
    assert column(spark, texts, T.stage_heads)[0] == ["h9", "tail", "end"]
    assert column(spark, texts, top_level_operators) == [["|", ";"], ["&&", "||"], []]


def test_long_lines(spark):
    """100,000 stages, and one stage of 100,000 quoted parts: no recursion and no copying of long arrays."""
    many = " | ".join(f"c{i} $(x;y)" for i in range(100_000))
    one = "'a'b" * 100_000 + "; z"
    got = column(spark, [many, one], T.stages)
    assert len(got[0]) == 100_000 and got[0][99_999] == "c99999 $(x;y)" and [len(s) for s in got[1]] == [400_000, 1]
    assert len(column(spark, [many], top_level_operators)[0]) == 99_999


def test_operators_behind_signs(spark):
    texts = ["a 2>&1 | b >> c 2> d > e", r"a \| b '|' \"|\"", "echo 2 & x; y22>z", "$(a | b) > `c | d` ; (e | f)", "a $ b && c", ""]
    assert column(spark, texts, top_level_operators) == [
        ["2>&1", "|", ">>", "2>", ">"], ["|"], [";", "2>"], [">", ";", "|"], ["&&"], []]
