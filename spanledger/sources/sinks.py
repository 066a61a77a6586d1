"""Sinks whose output does not depend on when or in what order the job ran."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions import text as T
from spanledger.operators.classify import closed_reason


def residue_rows(judged: DataFrame, anchor: list[str]) -> DataFrame:
    """Declined lines in written form: closed reason, anchor text, escaped line."""
    at = F.concat_ws("#", *[F.col(a).cast("string") for a in anchor])
    return judged.where(F.col("reason").isNotNull()).select(
        "family", "release", closed_reason(F.col("reason")).alias("r"), at.alias("a"),
        T.escape_invisible(F.col("text")).alias("x"))


def write_residue(judged: DataFrame, anchor: list[str], dest: str) -> None:
    """Residue partitioned by family and release, with a counts table beside it.

    Rows are range-partitioned within cells, so a cell of any size is written by many
    tasks, each file sorted by reason, anchor and text.
    """
    rows = residue_rows(judged, anchor)
    order = ["family", "release", "r", "a", "x"]
    (rows.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").partitionBy("family", "release").json(f"{dest}/rows"))
    (rows.groupBy("family", "release", "r").agg(F.count("*").alias("n"))
     .write.mode("overwrite").json(f"{dest}/counts"))


def canonical_json(df: DataFrame) -> Column:
    """A row as JSON with its columns in name order and nulls left out."""
    return F.to_json(F.struct(*sorted(df.columns)))


def write_canonical(df: DataFrame, order: list[str], dest: str) -> None:
    """Canonical JSON lines in a total order over all files."""
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
     .select(canonical_json(df).alias("value")).write.mode("overwrite").text(dest))


def text_block(lines: list[tuple[str, Column]], missing: str = "not captured") -> Column:
    """One fact per line; an absent fact is said to be absent, never left blank."""
    return F.concat_ws("\n", *[
        F.concat(F.lit(label + ": "), F.coalesce(F.when(F.trim(c) != "", c), F.lit(missing)))
        for label, c in lines])
