"""Crosswalk joins, pointer chains, reverse links and curated merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.operators.support import settled


def ordered_distinct(df: DataFrame, key: str, position: Column, value: str, name: str) -> DataFrame:
    """The distinct values per key in order of first position, joined by commas.

    Values are reduced to their first position before they are listed, so a list is as
    long as the value domain and not as the group. Null values leave an empty list.
    """
    first = df.groupBy(key, value).agg(F.min(position).alias("_at"))
    pairs = F.collect_list(F.when(F.col(value).isNotNull(), F.struct("_at", F.col(value).alias("v"))))
    return first.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(pairs), lambda x: x["v"]), ",").alias(name))


def best_per_key(df: DataFrame, keys: list[str], *order: Column, keep: list[str]) -> DataFrame:
    """The kept columns of each key's greatest row; combines on the map side, no sort."""
    top = F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)],
                         *[F.col(k) for k in keep])).alias("_top")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col("_top")[k].alias(k) for k in keep])


def first_per_key(df: DataFrame, keys: list[str], *order: Column, keep: list[str]) -> DataFrame:
    """The kept columns of each key's least row; combines on the map side, no sort."""
    top = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)],
                         *[F.col(k) for k in keep])).alias("_top")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col("_top")[k].alias(k) for k in keep])


def resolve_pointers(nodes: DataFrame) -> DataFrame:
    """Follows ``same_as`` pointers of any length to the row that holds a ``value``.

    ``nodes`` has ``node``, ``same_as`` (null where the row holds its own ``value``).
    Gives ``node, status, target, hops``; status is ok, dangling or cycle, and target the
    last node reached (null on a cycle). Each round doubles the length of every pointer,
    so a chain of length L takes log2(L) joins. A chain that is still open passes through
    nodes of every shorter length, so once a round closes no node the rest are on, or lead
    to, a cycle.
    """
    known = nodes.select(F.col("node").alias("_n"), F.col("same_as").alias("_p"))
    state = settled(
        nodes.where(F.col("same_as").isNotNull()).alias("a")
        .join(known.alias("k"), F.col("a.same_as") == F.col("k._n"), "left")
        .select("node", F.col("same_as").alias("at"), F.lit(1).cast("bigint").alias("hops"),
                F.when(F.col("k._n").isNull(), "dangling")
                .when(F.col("k._p").isNull(), "ok").otherwise("open").alias("status")))
    left, before = state.where(F.col("status") == "open").count(), -1
    while left not in (0, before):
        jump = state.select(F.col("node").alias("_n"), F.col("at").alias("_at"),
                            F.col("hops").alias("_hops"), F.col("status").alias("_status"))
        is_open = F.col("status") == "open"
        moved = (state.where(is_open).join(jump, F.col("at") == F.col("_n"))
                 .select("node", F.col("_at").alias("at"), (F.col("hops") + F.col("_hops")).alias("hops"),
                         F.col("_status").alias("status")))
        state = settled(state.where(~is_open).unionByName(moved))
        before, left = left, state.where(F.col("status") == "open").count()
    own = nodes.where(F.col("same_as").isNull()).select(
        "node", F.lit("ok").alias("status"), F.col("node").alias("target"),
        F.lit(0).cast("bigint").alias("hops"))
    cyclic = F.col("status") == "open"
    return own.unionByName(state.select(
        "node", F.when(cyclic, "cycle").otherwise(F.col("status")).alias("status"),
        F.when(~cyclic, F.col("at")).alias("target"),
        F.when(cyclic, F.lit(-1)).otherwise(F.col("hops")).cast("bigint").alias("hops")))


def reverse_links(rows: DataFrame, key: str, links: DataFrame, member: str,
                  block: int = 1000) -> DataFrame:
    """For every row the sorted list of members that link to it, in bounded blocks.

    Members of one block share ``member div block``, so no list outgrows the block even
    if a row is linked from everywhere. A row without links has one empty block.
    """
    pairs = links.select(key, member).distinct()
    lists = pairs.groupBy(key, F.expr(f"{member} div {block}").alias("block_no")).agg(
        F.array_join(F.array_sort(F.collect_list(member)), ",").alias("members"),
        F.count("*").alias("n"))
    return rows.select(key).join(lists, key, "left").select(
        key, F.coalesce("block_no", F.lit(0)).cast("bigint").alias("block_no"),
        F.coalesce("members", F.lit("")).alias("members"), F.coalesce("n", F.lit(0)).alias("n"))


def merge_curated(old: DataFrame, new: DataFrame, keys: list[str], curated: list[str],
                  release: str) -> DataFrame:
    """A fresh extract with the curated columns of the old table kept; nothing is dropped.

    All columns of both tables come out. A curated value of the old table wins unless it is null or
    empty; the other columns are those of the new row, or of the old one where the row has vanished.
    Such rows stay and carry the release that lost them in ``removed_in``.
    """
    held = [c for c in dict.fromkeys([*new.columns, *old.columns]) if c not in keys and c != "removed_in"]
    o = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in held if c in old.columns],
                   F.col("removed_in").alias("_removed"), F.lit(True).alias("_o"))
    n = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in held if c in new.columns], F.lit(True).alias("_n"))
    d = n.join(o, keys, "full")

    def value(c: str) -> Column:
        fresh, kept = (F.col(f"_{side}_{c}") if c in df.columns else None for side, df in (("new", new), ("old", old)))
        if fresh is None or kept is None:
            return kept if fresh is None else fresh
        if c in curated:
            return F.coalesce(F.when(kept.cast("string") != "", kept), fresh)
        return F.when(F.col("_n").isNull(), kept).otherwise(fresh)
    return d.select(
        *keys, *[value(c).alias(c) for c in held],
        F.when(F.col("_n").isNull(), F.coalesce("_removed", F.lit(release))).alias("removed_in"),
        F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "removed")
        .otherwise("kept").alias("state"))


def resolves_any(claims: DataFrame, dictionary: DataFrame, curated: DataFrame,
                 keys: list[str]) -> DataFrame:
    """Why each claim stands: found in a dictionary, curated, marked as no option, or not at all."""
    d = (claims.join(dictionary.select(*keys, F.lit(1).alias("_d")).distinct(), keys, "left")
         .join(curated.select(*keys, F.lit(1).alias("_c")).distinct(), keys, "left"))
    marked = ~F.col("name").startswith("-") & F.col("license_class").isNotNull()
    return d.select(*claims.columns, F.when(F.col("_d").isNotNull(), "dictionary")
                    .when(F.col("_c").isNotNull(), "curated").when(marked, "marked")
                    .otherwise("unresolved").alias("resolution"))
