"""Incremental ingest of captures as files arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanledger.sources.captures import SCHEMA, judged_captures

KEPT = "path string, body string, codes string, kept boolean"


def capture_stream(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of capture files as a stream; each file is delivered once."""
    return (spark.readStream.format("text").option("wholetext", "true")
            .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")))


def _first_keeps(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Marks the capture that holds a key: the one of an earlier batch, else the first path of this one.

    The state of a key is the path that holds it. Whatever the number of captures of a key, one row is held back.
    """
    best = None
    for p in parts:
        p = p[["path", "body", "codes"]].assign(kept=False)
        if p["codes"].iloc[0] or state.exists:
            yield p
            continue
        if best is not None:
            p = pd.concat([p, best])
        p = p.sort_values("path")
        best = p.iloc[:1]
        yield p.iloc[1:]
    if best is not None:
        state.update((best["path"].iloc[0],))
        yield best.assign(kept=True)


def keyed_captures(files: DataFrame) -> DataFrame:
    """(path, body, codes, kept) of a stream of files; the keys already held are the stream's own state."""
    judged = judged_captures(files)
    sound = F.size("codes") == 0
    # A capture with faults holds no key: it is a group of its own.
    named = judged.select("path", "body", F.array_join("codes", ",").alias("codes"),
                          F.when(sound, F.col("j.entry_id")).otherwise(F.col("path")).alias("entry"),
                          F.when(sound, F.col("j.rhel_version")).alias("release"))
    return named.groupBy("entry", "release").applyInPandasWithState(
        _first_keeps, KEPT, "path string", "update", GroupStateTimeout.NoTimeout)


def ingest_available(spark: SparkSession, path: str, dest: str, checkpoint: str) -> None:
    """Ingests what has arrived since the last run into ``dest`` and stops.

    A key already held is not taken again, whichever run brought it. What is held is kept in the stream's
    state store beside its offsets, so a batch costs its new files and nothing that was written is read again.
    Output is written per batch number, so a batch replayed after a failure overwrites itself.
    """
    def take(batch: DataFrame, number: int) -> None:
        batch.persist()
        good = batch.where("kept").select("path", F.from_json("body", SCHEMA).alias("j")).select("path", "j.*").drop("_bad")
        faults = F.when(F.col("codes") == "", F.array(F.lit("duplicate-key"))).otherwise(F.split("codes", ","))
        errors = batch.where("not kept").select("path", F.explode(faults).alias("code"))
        good.write.mode("overwrite").parquet(f"{dest}/captures/batch={number}")
        errors.write.mode("overwrite").parquet(f"{dest}/errors/batch={number}")
        batch.unpersist()

    query = (keyed_captures(capture_stream(spark, path)).writeStream.foreachBatch(take).outputMode("update")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
