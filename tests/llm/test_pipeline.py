import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline as P
from spanledger.llm.sharding import permuted
from tests.llm.brute import near_components

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, []
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns[:len(columns)] == columns
        held.append(docs.toPandas())
    toxic, near, clean, mix, shards = held
    want = near_components(list(zip(toxic["doc_id"].tolist(), toxic["text"].tolist())))
    assert set(near["doc_id"]) == {d for d, c in want.items() if d == c}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    gone = set(range(1000)) - set(toxic["doc_id"])
    assert sum(labels.get(d, 1) for d in gone) >= .9 * len(gone) and len(near) - len(clean) > 0
    assert set(mix["doc_id"]) <= set(clean["doc_id"]) and mix["doc_id"].value_counts().max() <= 3
    assert len(shards) == len(mix)
    place = permuted(shards["row_number"].to_numpy(), len(mix))
    assert (shards["shard"] == place % 24).all() and (shards["slot"] == place // 24).all()
    assert sorted(shards["row_number"]) == list(range(len(mix)))
    counts = np.bincount(shards["shard"])
    assert counts.max() - counts.min() <= 1


def test_run(spark):
    rows = P.run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(rows) and {"row_number", "shard", "slot"} <= set(rows.columns)


ODD = "doc_id long, text string, lang string, source string, n_chars long, hits string, row_key int, size int, finish string"


def odd_tables(spark, path, rows):
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ra", "se", "ti", "vo", "zu", "da", "fe")]
    rnd = np.random.default_rng(4)
    text = lambda n=60: " ".join(rnd.choice(words, n))
    item = " ".join(f"item{i}" for i in range(24)) + ". It is the very last answer."
    t = text()
    docs = [(5, t), (5, t), (None, t), (6, t), (7, text() + " " + item + " " + text()), (None, item), (None, None), (8, ""), (8, ""), (9, " \n"),
            (10, text(5000)), (11, text()), (11, text()), (None, text()), (None, text()), *[(20 + i, text()) for i in range(20)]] if rows else []
    spark.createDataFrame([(i, x, "en", "web" if (i or 0) % 2 else None, 1, "h", 3, 4, "f") for i, x in docs], ODD).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(20 + i, 1, int(i == 3)) for i in range(8)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    return docs


def test_odd_rows(spark, tmp_path):
    docs = odd_tables(spark, tmp_path, True)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    near = P.near_dedup(spark, frame, str(tmp_path)).collect()
    left = sorted(((r.doc_id, r.text) for r in near), key=repr)
    assert left == sorted([d for i, d in enumerate(docs) if i not in (0, 1, 2)], key=repr)
    clean = P.decontamination(spark, frame, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in clean), key=repr) == sorted([d for i, d in enumerate(docs) if i not in (4, 5)], key=repr)
    assert frame.columns == P.near_dedup(spark, frame, str(tmp_path)).columns == P.decontamination(spark, frame, str(tmp_path)).columns
    rows = P.run(spark, str(tmp_path)).collect()
    assert rows and {r.text for r in rows} <= {t for _, t in docs}


def test_empty_tables(spark, tmp_path):
    odd_tables(spark, tmp_path, False)
    assert P.run(spark, str(tmp_path)).collect() == []


def test_no_row_is_lost_without_labels_to_learn_from(spark, tmp_path):
    """No labels, labels without a value, and texts that no label can name: nothing is known to be toxic, so all stay."""
    docs = odd_tables(spark, tmp_path, True)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kinds = "doc_id long, quality int, toxic int"
    for name, labels in (("none", []), ("null", [(i, 1, None) for i in range(40)]), ("nameless", [(None, 1, 1)]), ("other", [(10 ** 6 + i, 1, 1) for i in range(40)])):
        spark.createDataFrame(labels, kinds).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert P.toxicity(spark, frame, f"{tmp_path}/{name}").count() == len(docs)
    assert P.toxicity(spark, frame, str(tmp_path)).count() == len(docs)
