import random

import pyarrow.parquet as pq
import pytest

from spanledger.llm.near_dedup import near_duplicates
from spanledger.llm.queries import QUERIES
from tests.llm.brute import near_components, shingle_set

SF = "/root/testdata/sf0.01"


def found(df):
    return {r.doc_id: r for r in df.collect()}


def test_whole_table_against_brute_force(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = near_components([(d["doc_id"], d["text"]) for d in docs])
    got = found(QUERIES["op4_near_dedup"](spark, SF))
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.n_shingles == len(shingle_set(d["text"])) for d in docs for r in [got[d["doc_id"]]])
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def family(seed, copies, edits):
    """Copies of one text with random edits, some of them copies of copies, and texts around one passage."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(80)]
    out = [base]
    for _ in range(copies):
        w = list(rnd.choice(out) if rnd.random() < .4 else base)
        for _ in range(rnd.randrange(edits)):
            w[rnd.randrange(len(w))] = word()
        out.append(w)
    passage = [word() for _ in range(55)]
    out += [[word() for _ in range(rnd.randrange(5, 30))] + passage for _ in range(copies // 2)]
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_large_family_loses_no_link(spark, seed):
    docs = family(seed, 250, 12)
    got = found(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {d: r.component_id for d, r in got.items()} == near_components(docs)


def test_odd_rows(spark):
    docs = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "one two", "x"), (5, "ONE  two", None), (6, "one two three", "x"),
            (7, "a b c d e f", "x"), (7, "q r s t u v", "x"), (8, "Q r s t u v", "x"), (None, "a b c d e f", "x"),
            (9, "é " * 30000, "x"), (9, "é " * 30000, "x")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, c string, n long")
    got = near_duplicates(df).collect()
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert len(got) == len(docs)
    assert by[1, 0] == 1 and by[2, 0] == 2 and by[3, 0] == 3
    assert by[4, 1] == by[5, 1] == 4 and by[6, 1] == 6
    assert by[7, 2] == 7 and by[8, 2] == 7 and by[9, 1] == 9
    assert [r.kept for r in got if r.doc_id is None] == [True]
    assert near_duplicates(df.limit(0)).collect() == []
