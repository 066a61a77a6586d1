"""Checks that return violation rows and never raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions.text import let
from spanledger.operators.support import dealt


def fk_violations(child: DataFrame, fk: str, parent: DataFrame, pk: str, label: str,
                  agree: list[tuple[str, str]] | None = None) -> DataFrame:
    """(check, code, key, n) for child keys without a parent, or whose attributes differ.

    Child rows are reduced to distinct keys (and attributes) before the join, so a hot
    key crosses the network once per map task.
    """
    agree = agree or []
    c = child.groupBy(F.col(fk).alias("_k"), *[F.col(a).alias(f"_c{i}") for i, (a, _) in enumerate(agree)]).agg(
        F.count("*").alias("n"))
    p = parent.select(F.col(pk).alias("_k"), *[F.col(b).alias(f"_p{i}") for i, (_, b) in enumerate(agree)]).distinct()
    p = p.withColumn("_found", F.lit(1))
    d = c.where(F.col("_k").isNotNull()).join(p, "_k", "left")
    code = F.when(F.col("_found").isNull(), "unresolved")
    for i in range(len(agree)):
        code = code.when(~F.col(f"_c{i}").eqNullSafe(F.col(f"_p{i}")), f"attribute-{agree[i][0]}")
    return (d.withColumn("code", code).where(F.col("code").isNotNull())
            .groupBy(F.lit(label).alias("check_name"), "code", F.col("_k").cast("string").alias("key"))
            .agg(F.sum("n").alias("n")))


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, code, column) of rows missing, extra, or different cell by cell."""
    l = left.select(*keys, *[F.col(c).alias(f"_l_{c}") for c in columns], F.lit(1).alias("_in_l"))
    r = right.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in columns], F.lit(1).alias("_in_r"))
    differing = F.array_compact(F.array(*[
        F.when(~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")), F.lit(c)) for c in columns]))
    d = l.join(r, keys, "full").select(*keys, (
        F.when(F.col("_in_l").isNull(), F.array(F.struct(F.lit("missing").alias("code"), F.lit("").alias("column_name"))))
        .when(F.col("_in_r").isNull(), F.array(F.struct(F.lit("extra").alias("code"), F.lit("").alias("column_name"))))
        .otherwise(F.transform(differing, lambda c: F.struct(F.lit("differs").alias("code"), c.alias("column_name"))))
    ).alias("_d"))
    return d.select(*keys, F.explode("_d").alias("d")).select(*keys, "d.*")


def missing_stale(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only: ``stale`` on the left, ``missing`` from it."""
    l = left.select(F.col(key).cast("string").alias("key")).distinct()
    r = right.select(F.col(key).cast("string").alias("key")).distinct()
    both = l.withColumn("_l", F.lit(1)).join(r.withColumn("_r", F.lit(1)), "key", "full")
    return (both.where(F.col("_l").isNull() | F.col("_r").isNull())
            .select("key", F.when(F.col("_r").isNull(), "stale").otherwise("missing").alias("side")))


def snapshot_drift(fresh: DataFrame, kept: DataFrame, volatile: tuple[str, ...] = ()) -> DataFrame:
    """Row multiset difference in both directions, volatile columns dropped first."""
    cols = sorted(c for c in fresh.columns if c not in volatile)
    f, k = fresh.select(*cols), kept.select(*cols)
    gained = f.exceptAll(k).withColumn("direction", F.lit("only-fresh"))
    return gained.unionByName(k.exceptAll(f).withColumn("direction", F.lit("only-kept")))


def rule_violations(df: DataFrame, label: str, key: Column, rules: list[tuple[str, Column]]) -> DataFrame:
    """(table, code, key) for every broken rule, all rules in one scan.

    A rule is a code and the condition that breaks it; a condition that is null has
    not been broken.
    """
    codes = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]))
    return df.select(F.lit(label).alias("table_name"), key.cast("string").alias("key"),
                     F.explode(codes).alias("code"))


def undeclared_columns(df: DataFrame, declared: set[str]) -> list[str]:
    return sorted(set(df.columns) - declared)


def check_summary(violations: DataFrame, checked: DataFrame, names: str) -> DataFrame:
    """Status per check: EMPTY when it looked at no row, FAIL with violations, else PASS."""
    bad = violations.groupBy(names).agg(F.count("*").alias("violations"))
    d = checked.join(bad, names, "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
    return d.withColumn("status", F.when(F.col("rows_checked") == 0, "EMPTY")
                        .when(F.col("violations") > 0, "FAIL").otherwise("PASS"))


SALTS = 16  # tasks that count a key before its counts meet


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys of more than one row. Most keys are unique, so no task combines those of a whole file or of a joined
    partition; a key that many rows hold is counted by several tasks first."""
    salted = df.select(*keys, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("_salt"))
    counts = dealt(salted, *keys, "_salt").groupBy(*keys, "_salt").agg(F.count("*").alias("_n")).drop("_salt")
    return dealt(counts, *keys).groupBy(*keys).agg(F.sum("_n").alias("n")).where(F.col("n") > 1)


def grid_gaps(entities: DataFrame, entity: str, slots: list, slot: str, slot_type: str,
              present: DataFrame) -> DataFrame:
    """Entity and slot pairs that lack an explicit row, and rows for unknown slots.

    The closed slot list is exploded inside each entity row; no table is crossed.
    """
    full = entities.select(entity, F.explode(F.array(*[F.lit(s).cast(slot_type) for s in slots])).alias(slot))
    have = present.select(entity, slot).distinct()
    gaps = full.join(have, [entity, slot], "left_anti").withColumn("code", F.lit("missing"))
    extra = have.where(~F.col(slot).isin(slots)).withColumn("code", F.lit("unknown-slot"))
    return gaps.unionByName(extra)


def reconcile(recorded: DataFrame, recounted: DataFrame, key: str) -> DataFrame:
    """Recorded counts against recounted ones: equal, stale, unrecorded or vanished."""
    d = (recorded.select(key, F.col("n").alias("recorded"))
         .join(recounted.select(key, F.col("n").alias("recounted")), key, "full"))
    return d.select(key, F.coalesce("recorded", F.lit(0)).alias("recorded"),
                    F.coalesce("recounted", F.lit(0)).alias("recounted"),
                    F.when(F.col("recorded").isNull(), "unrecorded")
                    .when(F.col("recounted").isNull(), "vanished")
                    .when(F.col("recorded") != F.col("recounted"), "stale")
                    .otherwise("equal").alias("status"))


CLAIMS = 2000  # claims that meet a document's row together


def resolve_anchors(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """Re-reads every citation. Gives claims whose anchor does not carry their text.

    ``claims``: claim_id, family, key, field, line_no, line_to, text, verbatim, exact; ``texts``: family, key, field,
    body, joined, one row a field. An anchor is a line (``line_no``, ``line_to`` null), a run of lines joined by
    spaces (``line_to`` set) or the whole field (``line_no`` null). A claim must be contained there, or equal it
    where ``exact``; a verbatim claim may not rest on a joined field or run nor span lines.

    Claims travel to the texts in blocks of bounded size, however many cite one field; lines are looked up by
    their number inside the text's row. A text without claims goes nowhere, one with claims moves once.
    """
    at = ["family", "key", "field"]
    parts = claims.groupBy(*at).agg(F.ceil(F.count("*") / CLAIMS).alias("_parts"))
    told = F.struct("claim_id", "line_no", "line_to", "text", "verbatim", "exact")
    blocks = claims.join(parts, at).groupBy(*at, F.pmod(F.xxhash64("claim_id", "line_no"), "_parts").alias("_part")).agg(
        F.collect_list(told).alias("_claims"))

    def reason(c: Column, lines: Column) -> Column:
        spot = (F.when(c["line_no"].isNull(), F.col("body"))
                .when(c["line_no"] < 1, None).when(c["line_to"].isNull(), F.get(lines, (c["line_no"] - 1).cast("int")))
                .when((c["line_to"] >= c["line_no"]) & (c["line_to"] <= F.size(lines)),
                      F.array_join(F.slice(lines, c["line_no"].cast("int"), (c["line_to"] - c["line_no"] + 1).cast("int")), " ")))
        holds = F.when(c["exact"], spot == c["text"]).otherwise(spot.contains(c["text"]))
        return (F.when(c["verbatim"] & c["text"].contains("\n"), "verbatim-spans-lines")
                .when(F.col("body").isNull() | spot.isNull(), "no-such-line").when(~holds, "text-not-on-line")
                .when(c["verbatim"] & (F.col("joined") | c["line_to"].isNotNull()), "verbatim-but-joined"))
    met = blocks.join(texts.select(*at, "body", "joined"), at, "left")
    judged = let(F.split("body", "\n", -1), lambda lines: F.filter(
        F.transform("_claims", lambda c: F.struct(c["claim_id"].alias("claim_id"), c["line_no"].alias("line_no"), reason(c, lines).alias("reason"))),
        lambda r: r["reason"].isNotNull()))
    return met.select(*at, F.explode(judged).alias("r")).select("r.claim_id", *at, "r.line_no", "r.reason")
