"""Stored snapshots of a set of tables, and their drift by two levels of digests.

A snapshot keeps each table partitioned by a bucket of its key's hash, with a digest of every bucket's rows.
Two snapshots are compared by the digests first; only buckets that differ are opened and their rows compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.functions.hashing import canonical_text

BUCKETS = 64
SUMS = [f"h{i}" for i in range(4)]


def _digests(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """(table_name, bucket, n, h0 to h3): for each bucket sums of the 32-bit pieces of its rows' digests, in any order."""
    told = rows.select("bucket", F.md5(canonical_text(rows, columns)).alias("d"))
    piece = lambda i: F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("bigint")
    return told.groupBy(F.lit(name).alias("table_name"), "bucket").agg(
        F.count("*").alias("n"), *[F.sum(piece(i)).alias(h) for i, h in enumerate(SUMS)])


def store(tables: dict[str, tuple[DataFrame, str]], path: str, buckets: int = BUCKETS) -> None:
    """Writes a snapshot; ``tables`` gives each table and its key. No table may have a column ``bucket``.

    Columns are kept in the order of their names. Rows of one key fall into one bucket; digests are those of the rows
    as written. The schema of each table is kept as text, so that empty tables are known too.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    schemas = []
    for name, (df, key) in sorted(tables.items()):
        columns = sorted(df.columns)
        bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
        # Rebalanced by adaptive execution: small buckets share a task, a bucket with a hot key is split.
        df.select(*columns, bucket.alias("bucket")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/tables/{name}")
        schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*columns).dtypes)
        schemas.append((name, key, schema))
        _digests(_stored(spark, path, name, schema), name, columns).write.mode("append").parquet(f"{path}/digests")
    spark.createDataFrame(schemas, "table_name string, key string, schema string").coalesce(1).write.parquet(f"{path}/schemas")


def _stored(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/tables/{name}")


def unequal_buckets(spark: SparkSession, fresh: str, kept: str) -> dict[str, list[int]]:
    """The buckets of each table that differ between two snapshots; at most tables times buckets."""
    kinds = "table_name string, bucket int, n long, " + ", ".join(f"{h} long" for h in SUMS)
    f, k = (spark.read.schema(kinds).parquet(f"{p}/digests") for p in (fresh, kept))
    same = reduce(Column.__and__, [F.col(f"f.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ["n", *SUMS]])
    d = f.alias("f").join(k.alias("k"), (F.col("f.table_name") == F.col("k.table_name")) & (F.col("f.bucket") == F.col("k.bucket")), "full")
    out: dict[str, list[int]] = {}
    for r in d.where(~same).select(F.coalesce("f.table_name", "k.table_name").alias("t"), F.coalesce("f.bucket", "k.bucket").alias("b")).collect():
        out.setdefault(r["t"], []).append(r["b"])
    return out


def drift(spark: SparkSession, fresh: str, kept: str, volatile: dict[str, list[str]] | None = None) -> DataFrame:
    """(table_name, code, key, n): tables and rows that only one snapshot has.

    Codes: ``missing-table`` (only the kept snapshot has it), ``extra-table``, ``schema`` (their columns differ, rows are
    not compared), ``only-fresh`` and ``only-kept`` rows with their key and number. ``volatile`` names columns that are
    left out when rows of differing buckets are compared.
    """
    told = [{r["table_name"]: r for r in spark.read.parquet(f"{p}/schemas").collect()} for p in (fresh, kept)]
    rows = [(t, "missing-table" if t in told[1] else "extra-table", None, 1) for t in sorted(set(told[0]) ^ set(told[1]))]
    both = sorted(set(told[0]) & set(told[1]))
    rows += [(t, "schema", None, 1) for t in both if told[0][t]["schema"] != told[1][t]["schema"]]
    found = [spark.createDataFrame(rows, "table_name string, code string, key string, n long")]
    for t, buckets in sorted(unequal_buckets(spark, fresh, kept).items()):
        if t in both and told[0][t]["schema"] == told[1][t]["schema"]:
            a, b = (_stored(spark, p, t, told[0][t]["schema"]).where(F.col("bucket").isin(buckets)).drop("bucket", *(volatile or {}).get(t, []))
                    for p in (fresh, kept))
            key = F.col(told[0][t]["key"]).cast("string").alias("key")
            for code, one, other in (("only-fresh", a, b), ("only-kept", b, a)):
                found.append(one.exceptAll(other).groupBy(F.lit(t).alias("table_name"), F.lit(code).alias("code"), key).agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, found)
