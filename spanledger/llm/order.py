"""Global row numbers and running totals without a window over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.operators.support import Shelf

IN_PART = (1 << 33) - 1


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that the frame does not have yet, whatever its case."""
    have = {c.lower() for c in df.columns}
    while wish.lower() in have:
        wish += "_"
    return wish


def numbered(df: DataFrame, by: list[Column], shelf: Shelf, name: str = "ranged") -> DataFrame:
    """The rows with ``row_number`` (a name that they must not have yet), gapless from 0 in the order of ``by`` (nulls first).

    The rows are dealt by range and sorted once; their places inside the parts are stored with them, and
    the sizes of the parts (one row for each) give the offsets.
    """
    place, offset = free_name(df, "place"), free_name(df, "offset")
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(place, F.monotonically_increasing_id())
    stored = shelf.put(placed, name)
    part = F.shiftright(place, 33)
    offsets = part_offsets(stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")), "part", "n")
    return stored.join(offsets.select(F.struct("part", "_before").alias(offset)), part == F.col(f"{offset}.part")).select(
        *df.columns, (F.col(f"{offset}._before") + F.col(place).bitwiseAND(F.lit(IN_PART))).alias("row_number"))


def part_offsets(totals: DataFrame, part: str, total: str) -> DataFrame:
    """(part, _before): the sum of all lower parts' totals. One row for each part of a table goes in."""
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, F.coalesce(F.sum(total).over(upto), F.lit(0)).alias("_before"))
