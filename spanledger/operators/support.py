"""Small helpers that keep plans safe at scale: columns made once, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are evaluated once per row.

    They come out of a one-element generator. A plain projection would be merged into the
    filters and projections above it, which repeats an expensive expression at every use.
    """
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline(one))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by key in partitions that nothing joins again, at least four to a core.

    Small shuffles of well-packed rows are joined to few partitions, and what follows would hold all their groups
    in one task.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which every executor can reach.

    Local sessions that name none get one of their own, as in tests. On a cluster a missing setting is
    an error: a folder of one machine would lose the rows that other machines write.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Shelf:
    """Tables of one run, written once to the shared folder and read back.

    They cut the lineage, outlive lost executors, and let readers prune columns. ``drop`` removes those
    that are no longer read; the rest goes when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/spanledger-{uuid.uuid4().hex}"
        self._path(self.root, "deleteOnExit")

    def _path(self, path: str, action: str, *more) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if action == "deleteOnExit":
            system.mkdirs(where)
        getattr(system, action)(where, *more)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._path(f"{self.root}/{name}", "delete", True)


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows once as a table in the shared folder and read it back."""
    return Shelf(df.sparkSession).put(df, "settled")

