import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spanledger.llm.language_id import SEGMENT, Parser, language_ids, samples, suffix_automaton
from spanledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, phrases string, _r int, score int"


def plain_letters(text):
    """For the letters of the tests' texts."""
    words = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
    return f" {words} ".encode() if re.search(r"[^\W\d_]", text or "") else b""


def plain_phrases(text, sample):
    """The longest match is sought anew at every phrase, in each segment of the text."""
    n = 0
    for i in range(0, len(text), SEGMENT):
        part, at = text[i:i + SEGMENT], 0
        while at < len(part):
            end = at + 1
            while end < len(part) and part[at:end + 1] in sample:
                end += 1
            at, n = end, n + 1
    return n


def test_automaton_holds_exactly_the_substrings():
    rnd = np.random.default_rng(2)
    data = rnd.integers(0, 3, 60)
    state, c, to = suffix_automaton(data)
    step = {(s, x): t for s, x, t in zip(state.tolist(), c.tolist(), to.tolist())}
    have = {tuple(data[i:j].tolist()) for i in range(60) for j in range(i + 1, 61)}
    for size in range(1, 7):
        for word in np.ndindex(*[3] * size):
            at = 0
            for x in word:
                at = step.get((at, x)) if at is not None else None
            assert (at is not None) == (word in have)


def test_phrases_against_search():
    rnd = np.random.default_rng(3)
    texts = [bytes(rnd.choice(list("abcdé ".encode()), int(n)).tolist()) for n in [0, 1, 5, 511, 512, 513, 3000, 0, 40]]
    told = tuple(bytes(rnd.choice(list(w), 400).tolist()) for w in (b"abc ", b"abd", b"z"))
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = Parser(told).phrases(np.frombuffer(b"".join(texts), np.uint8), at)
    assert got.tolist() == [[plain_phrases(t, s) for s in told] for t in texts]
    assert Parser(()).phrases(np.zeros(3, np.uint8), np.array([0, 3])).shape == (1, 0)


def odd_rows():
    en = ["The house on the hill, and THE river.", "A river of the house; the hill is green 12!", "and the green hill"]
    fr = ["La maison sur la colline et la rivière", "une rivière de la maison, la colline est verte", "et la colline verte"]
    rows = [(i, en[i % 3], "en") for i in range(6)] + [(10 + i, fr[i % 3], "fr") for i in range(9)]
    return rows + [(30, None, "en"), (31, "", "fr"), (32, "12 + 3 = ?", "fr"), (33, "la colline", None), (33, "la colline", None),
                   (None, "the river", "fr"), (34, "hill " * 3000, None), (35, "Й", None), (36, "́", "en"), (37, "x" * 700, None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2) for r in rows], SCHEMA)


def test_odd_rows(spark):
    learn = F.coalesce(F.col("doc_id") < 32, F.lit(False))
    docs = frame(spark, odd_rows()).repartition(3)
    told = samples(docs.where(learn), "doc_id", "text", "lang")
    assert {k: n for k, n, _ in told} == {"en": 6, "fr": 9}
    told.sort(key=lambda x: (-x[1], x[0]))
    want = []
    for i, text, _ in odd_rows():
        t = plain_letters(text)
        n = {k: plain_phrases(t, s) for k, _, s in told}
        best = min(told, key=lambda x: n[x[0]] * np.log2(len(x[2])))[0] if t else "und"
        want.append((i, best, tuple(sorted(n.items()))))
    got = language_ids(docs, learn).collect()
    assert sorted(((r.doc_id, r.lang_pred, tuple(sorted(r.phrases.items()))) for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 < r.score <= 1 if r.lang_pred != "und" else r.score == 0 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (30, 31, 32, 36)} == {"und"}


def test_nothing_learned(spark):
    assert language_ids(frame(spark, []), F.lit(True)).collect() == []
    got = language_ids(frame(spark, odd_rows()), F.lit(False)).collect()
    assert len(got) == len(odd_rows()) and {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


@pytest.fixture(scope="module")
def truth():
    return {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}


def test_held_out_rows(spark, truth):
    rows = QUERIES["op11_language_id"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    test = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    print("right", sum(test) / len(test), "of", len(test))
    assert sum(test) > .99 * len(test)


def test_many_languages_and_scripts(spark):
    words = {"el": "και το σπίτι στο λόφο με το ποτάμι", "ru": "и дом на холме у реки", "tr": "ev tepede ve nehir yanında",
             "hi": "घर पहाड़ी पर और नदी के पास", "zh": "房子在山上 河边 有树"}
    rows = [(100 * j + i, " ".join(np.random.default_rng(i).permutation(t.split())), k) for j, (k, t) in enumerate(words.items()) for i in range(8)]
    got = language_ids(frame(spark, rows), F.col("doc_id") % 2 == 0).collect()
    want = {i: k for i, _, k in rows}
    assert all(r.lang_pred == want[r.doc_id] for r in got)
