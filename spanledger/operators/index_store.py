"""An inverted index as a stored table whose readers open only the parts that hold their terms.

Postings are lists of ids, partitioned by family and by a bucket of the token's hash, and sorted by token in each file. A
small vocabulary (family, bucket, token, rows) is stored beside them. A search finds the tokens that hold its
terms in the vocabulary; the (family, bucket) pairs of those tokens, bounded in number by the layout, prune the
postings' partitions at run time, so families and buckets without a term are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.operators import search as S

BUCKETS = 16


class StoredIndex:
    def __init__(self, spark: SparkSession, path: str):
        layout = spark.read.parquet(f"{path}/layout").first()
        self.family, self.id_col = layout["family"], layout["id_col"]
        kind, id_type = layout["family_type"], layout["id_type"]
        self.vocabulary = spark.read.schema(f"{self.family} {kind}, bucket int, token string, n long").parquet(f"{path}/vocabulary")
        self.lists = spark.read.schema(f"token string, {self.id_col} array<{id_type}>, {self.family} {kind}, bucket int").parquet(f"{path}/postings")

    @property
    def postings(self) -> DataFrame:
        """One row per token and row that holds it."""
        return self.lists.withColumn(self.id_col, F.explode(self.id_col))

    @classmethod
    def write(cls, frame: DataFrame, path: str, family: str = "kind", id_col: str = "id", hay: str = "hay",
              buckets: int = BUCKETS) -> "StoredIndex":
        """Stores the index of ``frame``. Adaptive execution splits a large bucket over several files, each sorted by token.

        Postings are lists from the task that cuts them, so that lists and not single postings are shuffled and sorted.
        """
        spark, types = frame.sparkSession, dict(frame.dtypes)
        lists = S.posting_lists(frame, family, id_col, hay).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
        # Dealt by bucket without a sampling pass, which would cut all texts into tokens twice.
        (lists.hint("rebalance", family, "bucket").sortWithinPartitions(family, "bucket", "token")
         .write.partitionBy(family, "bucket").parquet(f"{path}/postings"))
        kept = spark.read.schema(f"token string, n long, {family} {types[family]}, bucket int").parquet(f"{path}/postings")
        kept.groupBy(family, "bucket", "token").agg(F.sum("n").alias("n")).write.parquet(f"{path}/vocabulary")
        spark.createDataFrame([(family, types[family], id_col, types[id_col])], "family string, family_type string, id_col string, id_type string") \
            .coalesce(1).write.parquet(f"{path}/layout")
        return cls(spark, path)

    def _lists_of(self, queries: list[str]) -> DataFrame:
        pieces = sorted({p for q in queries for p in re.findall(S.TOKEN, q.lower())})
        holds = F.col("token").rlike("|".join(map(re.escape, pieces)) if pieces else r"\z\A.")
        # At most families times buckets rows, whatever the index holds.
        parts = F.broadcast(self.vocabulary.where(holds).select(self.family, "bucket").distinct())
        return self.lists.where(holds).join(parts, [self.family, "bucket"], "left_semi")

    def postings_of(self, queries: list[str]) -> DataFrame:
        """The postings of all tokens that hold a piece of a term; other families and buckets are not opened."""
        return self._lists_of(queries).withColumn(self.id_col, F.explode(self.id_col))

    def search(self, frame: DataFrame, queries: list[str]) -> DataFrame:
        """(query, family, id) of the rows of ``frame`` that hold all terms of a query, verified on their texts."""
        return S.index_search(self._lists_of(queries), frame, queries, [self.family, self.id_col], listed=self.id_col)


def unresolved(index: StoredIndex, frame: DataFrame, hay: str = "hay") -> DataFrame:
    """Postings whose row is not there or does not hold the token, and rows' tokens without a posting."""
    key = [index.family, index.id_col]
    told = index.postings.select(*key, "token")
    real = S.postings(frame, index.id_col, hay, index.family, min_len=1).select(*key, "token")
    lost = told.join(real, [*key, "token"], "left_anti").withColumn("code", F.lit("unresolved"))
    return lost.unionByName(real.join(told, [*key, "token"], "left_anti").withColumn("code", F.lit("unposted")))
