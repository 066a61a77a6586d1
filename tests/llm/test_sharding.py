import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spanledger.llm.queries import QUERIES
from spanledger.llm.sharding import permuted, row_at, sharded, write_shards

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 99991])
def test_permutation_and_inverse(n):
    place = permuted(np.arange(n), n)
    assert sorted(place.tolist()) == list(range(n))
    assert (row_at(place, n) == np.arange(n)).all()


def test_whole_table(spark):
    docs = sorted(pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist(), key=lambda d: d["doc_id"])
    got = {r.doc_id: r for r in QUERIES["op9_sharding"](spark, SF).collect()}
    place = permuted(np.arange(len(docs)), len(docs))
    for d, p in zip(docs, place.tolist()):
        r, raw = got[d["doc_id"]], (d["text"] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        assert (r.shard, r.slot) == (p % 24, p // 24)
    counts = np.bincount([r.shard for r in got.values()])
    assert len(counts) == 24 and counts.max() - counts.min() <= 1


def test_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(None, None, 1), (1, "a", 1), (1, "a", 1), (1, "", 1), (2, "é" * 100000, 1)], "doc_id long, text string, shard int")
    got = sharded(df, [F.col("doc_id"), F.col("text")], 3)
    rows = got.collect()
    assert sorted((r.row_number) for r in rows) == list(range(5))
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    write_shards(got, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    assert sharded(df.limit(0), [F.col("doc_id")]).collect() == []
