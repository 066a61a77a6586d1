"""All references between tables at once: each table is read once, whatever checks name it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    name: str
    child: str
    column: str
    parent: str
    key: str
    reverse: bool = False  # whether every parent must have a child as well


def _stacked(df: DataFrame, checks: list[tuple[str, str]]) -> DataFrame:
    """(check_name, key, n) over all checks of a table from one scan of their columns; null keys refer to nothing."""
    pairs = F.array(*[F.struct(F.lit(name).alias("check_name"), F.col(c).cast("string").alias("key")) for name, c in checks])
    return df.select(F.explode(pairs).alias("p")).select("p.*").where("key is not null").groupBy("check_name", "key").agg(F.count("*").alias("n"))


def reference_violations(tables: dict[str, DataFrame], checks: list[Reference]) -> DataFrame:
    """(check_name, code, key, n): child keys without a parent (n rows have them), and with ``reverse`` parents
    without a child.

    The rows of each table are reduced to distinct (check, key) on the map side, so a hot key crosses the
    network once for each task; one full join on (check, key) answers all checks in both directions.
    """
    def side(table: str, column: str) -> DataFrame:
        named: dict[str, list[tuple[str, str]]] = {}
        for c in checks:
            named.setdefault(getattr(c, table), []).append((c.name, getattr(c, column)))
        return reduce(DataFrame.union, [_stacked(tables[t], own) for t, own in sorted(named.items())])
    both = [c.name for c in checks if c.reverse]
    d = side("child", "column").join(side("parent", "key").withColumnRenamed("n", "held"), ["check_name", "key"], "full")
    code = F.when(F.col("held").isNull(), "unresolved").when(F.col("n").isNull() & F.col("check_name").isin(both), "no-child")
    return d.select("check_name", code.alias("code"), "key", F.coalesce("n", F.lit(0)).alias("n")).where("code is not null")
