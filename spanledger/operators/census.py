"""Counts of operators, shapes and invoked programs over command lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions import text as T

OPERATORS = ["2>&1", "&&", "||", "2>", ">>", "|", ";", ">"]
# Operators, and runs that hide them: escapes, quotes and back-quotes. Substitutions are followed by depth.
PIECE = (r"""\\.|'[^']*(?:'|\z)|"(?:\\.|[^"\\])*+(?:"|\z)|`[^`]*(?:`|\z)|\$\(|[()]"""
         r"""|2>&1|&&|\|\||2>|>>|[|;>]|[^\\'"`$()|;>&2]++|[\\$&2]""")


def top_level_operators(c: Column) -> Column:
    """The shell operators a shell would act on, in order, outside substitutions of any depth."""
    return F.array_compact(T.by_depth(F.regexp_extract_all(c, F.lit(PIECE), F.lit(0)),
                                      lambda p, d: F.when((d == 0) & p.isin(OPERATORS), p)))


def operator_census(df: DataFrame, text: str) -> DataFrame:
    """Lines and occurrences per operator."""
    found = df.select(F.explode(top_level_operators(F.col(text))).alias("operator"))
    return found.groupBy("operator").agg(F.count("*").alias("n"))


def shape_census(df: DataFrame, text: str) -> DataFrame:
    """Lines per shape, the sequence of a line's operators."""
    shaped = df.select(F.array_join(top_level_operators(F.col(text)), " ").alias("shape"))
    return shaped.groupBy("shape").agg(F.count("*").alias("n"))


def expressible(c: Column, closed: list[str]) -> Column:
    """True when a line uses only the closed operators, no substitution and no loop."""
    ops = top_level_operators(c)
    loop = c.rlike(r"\bfor\b.*\bdo\b|\bwhile\b.*\bdo\b|\bfunction\b")
    return F.forall(ops, lambda o: o.isin(closed)) & ~c.contains("$(") & ~c.contains("`") & ~loop


def head_census(df: DataFrame, text: str) -> DataFrame:
    """Stages per invoked program, looked up behind wrappers."""
    heads = df.select(F.explode(T.stage_heads(F.col(text))).alias("head"))
    return heads.where(F.col("head") != "").groupBy("head").agg(F.count("*").alias("n"))


def mode_per_group(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's most frequent value, the smaller one on a tie."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    top = F.max(F.struct("n", (-F.col(value)).alias("v"))).alias("_t")
    return counts.groupBy(key).agg(top).select(key, (-F.col("_t.v")).alias(value), F.col("_t.n").alias("n"))
