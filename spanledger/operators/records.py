"""From mined hits to the record table, and the ledger that audits what was written.

The chain writes three tables: the judged lines, the records (one for each distinct taken text) and the
residue (declined lines). The ledger's columns come from different ones of them: candidates from the source
lines, classified and residue from the judged table, recorded and records from the record table as read
back, the residue's recount from the residue table. So a loss between two steps shows as an imbalance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spanledger.functions import text as T
from spanledger.functions.hashing import content_id
from spanledger.operators.ledger import CELL
from spanledger.operators.patterns import name_of, pattern_rank
from spanledger.operators.support import Shelf


def finalised(hits: DataFrame, rank: Column | None = None) -> DataFrame:
    """One record for each text of ``hits``: text, tool, family, release, governing, verbatim_span.

    ``cells`` holds the hits of each (family, release) whatever citations are kept, ordered. A text that looks cut
    off is never verbatim. ``stages`` are the programs of a line with more than one stage, else null. A
    rating comes from the patterns (``rank``, over the column ``text``) alone: a record without one is unrated.
    The first aggregate makes one row for each text and cell on the map side, so a text that a third of all
    lines hold reaches the second as a row for each cell.
    """
    per_cell = hits.groupBy("text", "tool", *CELL).agg(
        F.count("*").alias("n"), F.bool_or("governing").alias("governing"), F.bool_and("verbatim_span").alias("verbatim_span"))
    d = per_cell.groupBy("text", "tool").agg(
        F.sum("n").alias("n"), F.bool_or("governing").alias("governing"), F.bool_and("verbatim_span").alias("verbatim_span"),
        F.array_sort(F.collect_list(F.struct("family", "release", "n"))).alias("cells"))
    heads, cut = T.stage_heads(F.col("text")), T.looks_truncated(F.col("text"))
    by_size = F.array_sort(F.transform(F.array_distinct("cells.release"), lambda v: F.struct(F.length(v).alias("k"), v.alias("v"))))
    return d.select(
        content_id(F.col("text")).alias("id"), "tool", "text", F.when(F.col("governing"), "governing").otherwise("documentary").alias("authority"),
        (F.col("verbatim_span") & ~cut).alias("verbatim_span"), cut.alias("truncated"),
        F.when(F.size(heads) > 1, heads).alias("stages"), name_of(pattern_rank(F.col("text")) if rank is None else rank).alias("rating"),
        F.transform(by_size, lambda x: x["v"]).alias("releases"), "cells", "n")


def write_records(records: DataFrame, shelf: Shelf, name: str = "records") -> DataFrame:
    """The records in their order (tool, text, id), written and read back."""
    order = ["tool", "text", "id"]
    # Stored before they are ranged: the bounds are drawn from a pass of their own.
    loose = shelf.put(records, f"{name}-loose")
    kept = shelf.put(loose.repartitionByRange(*order).sortWithinPartitions(*order), name)
    shelf.drop(f"{name}-loose")
    return kept


class Mined:
    """The tables of one mining run. ``judged`` has text, tool, reason, family, release and the hits' columns."""

    def __init__(self, judged: DataFrame, rank: Column | None = None):
        shelf = Shelf(judged.sparkSession)
        seen = Observation()
        watched = judged.observe(seen, F.count("*").alias("lines"), F.count_if(F.col("reason").isNull()).alias("taken"))
        self.judged = shelf.put(watched, "judged")
        #: What passed while the judged lines were written: {"lines": , "taken": }.
        self.observed = seen.get
        self.records = write_records(finalised(self.judged.where(F.col("reason").isNull()), rank), shelf)
        self.residue = shelf.put(self.judged.where(F.col("reason").isNotNull()).select(*CELL, "reason", "text"), "residue")


def audit(candidates: DataFrame, judged: DataFrame, records: DataFrame, residue: DataFrame) -> DataFrame:
    """(family, release, candidates, classified, residue, recorded, records, unclassified_residue, residue_recount).

    ``candidates`` is (family, release) of each source line that should have been judged. A cell that any of
    the tables lacks counts zero there.
    """
    source = candidates.groupBy(*CELL).agg(F.count("*").alias("candidates"))
    seen = judged.groupBy(*CELL).agg(
        F.count_if(F.col("reason").isNull()).alias("classified"), F.count_if(F.col("reason").isNotNull()).alias("residue"),
        F.count_if(F.col("reason") == "unparseable").alias("unclassified_residue"))
    kept = records.select(F.explode("cells").alias("c")).groupBy("c.family", "c.release").agg(
        F.sum("c.n").alias("recorded"), F.count("*").alias("records"))
    again = residue.groupBy(*CELL).agg(F.count("*").alias("residue_recount"))
    d = source.join(seen, CELL, "full").join(kept, CELL, "full").join(again, CELL, "full")
    names = ["candidates", "classified", "residue", "recorded", "records", "unclassified_residue", "residue_recount"]
    return d.select(*CELL, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def imbalances(ledger: DataFrame) -> DataFrame:
    """(family, release, code) of each rule that a cell of the ledger breaks."""
    codes = F.array_compact(F.array(
        F.when(F.col("classified") + F.col("residue") != F.col("candidates"), "candidates"),
        F.when(F.col("recorded") != F.col("classified"), "recorded"),
        F.when((F.col("classified") == 0) & (F.col("candidates") > 0), "zero-classified"),
        F.when(F.col("candidates") == 0, "cell-not-in-source"),
        F.when(F.col("residue_recount") != F.col("residue"), "recount")))
    return ledger.select(*CELL, F.explode(codes).alias("code"))
