"""Rules as data, compiled into one scan for each table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.operators.integrity import rule_violations

#: A rule is a row of this table. ``column`` is judged; ``other`` and ``equals`` make it depend on another column.
RULE = "table_name string, code string, kind string, column string, listed array<string>, other string, equals string"


def _broken(rule, df: DataFrame) -> Column:
    """The condition that breaks a rule. A column that the table lacks counts as null in every row."""
    have = set(df.columns)
    of = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    c, listed = of(rule["column"]), list(rule["listed"] or [])
    text = c.cast("string")
    blank = c.isNull() | (F.trim(text) == "")
    applies = F.lit(True) if rule["other"] is None else F.coalesce(of(rule["other"]).cast("string") == rule["equals"], F.lit(False))
    kinds = {
        "required": lambda: blank,
        "enum": lambda: c.isNotNull() & ~text.isin(listed),
        "one-of": lambda: reduce(Column.__add__, [of(n).isNotNull().cast("int") for n in listed], F.lit(0)) != 1,
        "conditional": lambda: applies & blank,
        "forbidden": lambda: applies & ~blank,
        "agrees": lambda: ~c.eqNullSafe(of(rule["other"])),
        "undeclared": lambda: F.size(F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")),
                                                    F.array(*map(F.lit, listed)).cast("array<string>"))) > 0,
        "pattern": lambda: c.isNotNull() & ~text.rlike(listed[0]),
    }
    if rule["kind"] not in kinds:
        raise ValueError(f"no such kind of rule: {rule['kind']}")
    return kinds[rule["kind"]]()


def judged_by_table(tables: dict[str, tuple[DataFrame, str]], rules: DataFrame) -> DataFrame:
    """(table_name, code, key) of every row that breaks a rule; ``tables`` gives each table and its key.

    Kinds: ``required``; ``enum`` (null or in ``listed``); ``one-of`` (exactly one of the ``listed`` columns is set);
    ``conditional`` (required where ``other`` equals) and ``forbidden`` (unset there, or everywhere without ``other``);
    ``agrees`` (equal to the column ``other``); ``undeclared`` (a JSON object has only the ``listed`` keys);
    ``pattern``. Every table is scanned once, whatever the number of its rules. A table that is named by a rule
    and not given yields one row, ``no-such-table``.
    """
    told: dict[str, list] = {}
    for r in rules.collect():  # the rules are a short table of settings
        told.setdefault(r["table_name"], []).append(r)
    spark, out = rules.sparkSession, []
    for name, own in sorted(told.items()):
        if name in tables:
            df, key = tables[name]
            out.append(rule_violations(df, name, F.col(key), [(r["code"], _broken(r, df)) for r in own]))
        else:
            out.append(spark.createDataFrame([(name, None, "no-such-table")], "table_name string, key string, code string"))
    return reduce(DataFrame.unionByName, out)
