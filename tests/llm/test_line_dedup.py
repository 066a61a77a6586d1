import numpy as np

from spanledger.llm.line_dedup import Shards, dedup_lines
from spanledger.llm.perfect_hash import MinimalHash
from spanledger.llm.queries import ORACLES, QUERIES
from tools.compare import compare, connect

SF = "/root/testdata/sf0.01"


def test_against_sql(spark):
    got = QUERIES["op5_line_dedup"](spark, SF).toPandas()
    assert compare(got, connect(SF).execute(ORACLES["op5_line_dedup"]).fetchdf()) == "ok"
    assert got["n_dropped"].sum() > 0


def test_minimal_hash_is_one_to_one_and_packs():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 30000):
        h1, h2 = rnd.integers(0, 1 << 63, (2, n), dtype=np.uint64)
        table = MinimalHash.build(h1, h2)
        again = MinimalHash(table.sizes, table.packed())
        assert sorted(again.number(h1, h2).tolist()) == list(range(n))


def test_many_shards_probe_alike(spark, monkeypatch):
    monkeypatch.setattr("spanledger.llm.line_dedup.SHARD_KEYS", 40)
    monkeypatch.setattr("spanledger.llm.line_dedup.HELD", 2)
    docs = spark.createDataFrame([(d, "\n".join(f"line number {j} of a text that repeats a lot" for j in range(d % 300))) for d in range(900)],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    line = lambda j: f"line number {j} of a text that repeats a lot"
    for d in range(900):  # line j is in 3 * (299 - j) documents, the largest of them is 899
        assert got[d].text == "\n".join(line(j) for j in range(d % 300) if d == 899 or 3 * (299 - j) < 5)


def test_odd_rows(spark):
    long = "é" * 39 + "x"
    docs = [(1, f"  {long}\t\nshort\n", 7), (2, long.upper().replace("É", "é"), 7), (3, f"{long}\n{long}\nother", 7), (3, f"{long}", 7), (4, long, 7),
            (5, f"a\n{long}\r\nb\n{long}", 7), (None, f"{long}\nq", 7), (6, None, 7), (7, "", 7), (8, "é" * 39 + "\n" + "z\n" * 50000, 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_lines int")
    got = {(r.doc_id, r.n_lines): r for r in dedup_lines(df).collect()}
    assert got[1, 3].text == "short\n" and got[2, 1].text == "" and got[3, 3].text == "other" and got[3, 1].text == ""
    assert got[5, 4].text == f"a\n{long}\r\nb\n{long}" and got[5, 4].n_dropped == 0
    assert got[None, 2].text == "q" and got[6, 1].text == "" and got[7, 1].text == "" and got[8, 50002].n_dropped == 0
    four = df.where("doc_id < 5").where("text is not null")
    assert sum(r.n_dropped for r in dedup_lines(four).collect()) == 0
    assert dedup_lines(df.limit(0)).collect() == []
