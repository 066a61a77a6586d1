"""One record per distinct text, with its citations in a table beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.functions import text as T
from spanledger.functions.hashing import content_id, text_key
from spanledger.operators.windows import first_per_group

OCC = ["release", "s", "g", "p"]


def citations(hits: DataFrame, guide_cap: int = 2, per: list[str] | None = None) -> DataFrame:
    """Distinct (text, release, s, g, p), each with the field and line of its first hit.

    Texts appear as their ``key``. Guide citations (``g`` set) stop at ``guide_cap`` per
    text, or per text and ``per``. The long form keeps a line that a third of all documents
    share from becoming one row.
    """
    keyed = hits.select(text_key(F.col("text")).alias("key"), *OCC, "seq", "field", "line_no")
    first = keyed.groupBy("key", *OCC).agg(F.min(F.struct("seq", "field", "line_no")).alias("_first"))
    flat = first.select("key", *OCC, "_first.*")
    capped = first_per_group(flat.where(F.col("g").isNotNull()), ["key", *(per or [])],
                             ["seq"], guide_cap).drop("position")
    return flat.where(F.col("g").isNull()).unionByName(capped)


def release_list(column: str):
    """Distinct releases as text, numeric ones in numeric order."""
    by_size = F.array_sort(F.transform(F.collect_set(column), lambda v: F.struct(F.length(v), v.alias("v"))))
    return F.array_join(F.transform(by_size, lambda x: x["v"]), ",")


def dedupe(hits: DataFrame) -> DataFrame:
    """Records: governing if any hit is, verbatim only if all are, first hit names the tool.

    All values are plain aggregates that combine on the map side. A truncated text is
    never verbatim.
    """
    cut = T.looks_truncated(F.col("text"))
    governing = F.bool_or(F.col("authority") == "governing")
    first = F.min(F.struct("seq", "tool", "kind", "license_class"))
    return (hits.groupBy("text").agg(
                F.count("*").alias("n"), governing.alias("_gov"), first.alias("_first"),
                F.bool_and("verbatim_span").alias("_verbatim"),
                release_list("release").alias("releases"),
                F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))
            .select(content_id(F.col("text")).alias("id"),
                    F.when(F.col("_gov"), "governing").otherwise("documentary").alias("authority"),
                    F.when(F.col("_gov"), "verbatim-ok").otherwise(F.col("_first.license_class"))
                    .alias("license_class"),
                    (F.col("_verbatim") & ~cut).alias("verbatim_span"), cut.alias("truncated"),
                    F.col("_first.kind").alias("kind"), F.col("_first.tool").alias("tool"),
                    "text", "releases", "families", "n"))
