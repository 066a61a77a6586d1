"""Counts of declined lines by reason, and caps that only go down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.functions import words as W

CELL = ["family", "release"]


def reason_pivot(judged: DataFrame) -> DataFrame:
    """Declined lines per cell with one column per reason of the closed set."""
    names = {r: r.replace("-", "_") for r in W.RESIDUE_REASONS}
    p = (judged.where(F.col("reason").isNotNull()).groupBy(*CELL)
         .pivot("reason", W.RESIDUE_REASONS).count())
    return p.select(*CELL, *[F.coalesce(F.col(f"`{r}`"), F.lit(0)).alias(n)
                             for r, n in names.items()])


def ratchet(current: DataFrame, baseline: DataFrame, keys: list[str], value: str, cap: str,
            as_of: str) -> DataFrame:
    """Status of each cell against its pinned cap; ``as_of`` is an ISO date, never the clock."""
    d = (current.withColumn("_cur", F.lit(1))
         .join(baseline.withColumn("_base", F.lit(1)), keys, "full"))
    retire = F.try_to_timestamp("retire_by", F.lit("yyyy-MM-dd"))
    status = (
        F.when(F.col("_base").isNull(), "new-cell")
        .when(F.col("_cur").isNull(), "missing-row")
        .when(F.coalesce("owner", F.lit("")) == "", "no-owner")
        .when(retire.isNull(), "bad-date")
        .when(F.col("retire_by") < F.lit(as_of), "expired")
        .when(F.col(value) > F.col(cap), "grew")
        .when(F.col(value) < F.col(cap), "improved").otherwise("held"))
    return d.select(*keys, F.coalesce(value, F.lit(-1)).alias(value),
                    F.coalesce(cap, F.lit(-1)).alias(cap), status.alias("status"))
