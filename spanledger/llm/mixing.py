"""Mixing sources to target weights by weighted fair queueing.

Every source offers its documents in a shuffled order, again and again up to a number of rounds. The
virtual finish time of a copy is the words its source has offered up to its end, divided by the source's
target. Sorted by that time, all sources advance in step with their targets, so a cut at the budget
leaves each of them within about one document of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.llm.order import free_name
from spanledger.operators.support import Shelf

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 3
TIMES = 4096  # classes of virtual time when the cut is sought


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, weight): the weights in turn, sources by code point and null last. One row a source."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select("source", F.element_at(F.array(*map(F.lit, cycle)), (turn % len(cycle) + 1).cast("int"))
                          .cast("long").alias("weight"))


def targets(sizes: DataFrame, weights: DataFrame, share: float = 1.0, rounds: int = ROUNDS) -> DataFrame:
    """(source, source_size, target): the budget by weight, none above ``rounds`` times its source.

    The excess of full sources goes to the others by weight until none is above. With sources sorted by
    capacity over weight this is one level: the first place where the rest of the budget over the rest of
    the weights is at most that ratio. The tables have one row for each source.
    """
    s = sizes.alias("s").join(weights.alias("w"), F.expr("s.source <=> w.source")).select(
        "s.source", "source_size", "weight", (rounds * F.col("source_size")).alias("cap"))
    s = s.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("budget", F.floor(F.sum("source_size").over(every) * F.lit(share)))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
                     / F.sum("weight").over(after))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level")))
                     .over(every)["level"])
    fair = F.col("level") * F.col("weight")
    return s.select("source", "source_size", "budget", F.when(F.col("level").isNull() | (F.col("ratio") < F.col("level")),
                    F.col("cap").cast("double")).otherwise(fair).alias("target"))


def queued(docs: DataFrame, shelf: Shelf, weights: DataFrame | None = None, share: float = 1.0, rounds: int = ROUNDS,
           key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, finish, mark): the decision on each row of ``docs``.

    ``taken`` counts the words of the copies that the mix takes, ``finish`` has their finish times.
    ``weights`` is (source, weight); without it weights 5, 2, 1 go round. A null text has size 0 and is
    taken in no copy; a null source is a source. Rows that share a key come in the order of their sizes and of ``mark``,
    a hash of the text.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"), F.xxhash64(text).alias("mark"))
    rows = shelf.put(rows.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "sizes")
    # The shuffled order inside a source is that of the digests; a source is windowed in 256 parts of it.
    totals = rows.groupBy("source", F.substring("h", 1, 2).alias("part")).agg(F.sum("size").alias("n"))
    sizes = totals.groupBy("source").agg(F.sum("n").alias("source_size"))
    goal = targets(sizes, weights if weights is not None else cycled_weights(sizes.select("source")), share, rounds)
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("source", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base")).alias("b").join(
        goal.alias("g"), F.expr("b.source <=> g.source")).select(
        F.col("b.source").alias("s"), "part", "base", "source_size", "budget", "target")
    inner = Window.partitionBy("source", "part").orderBy("h", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("part", F.substring("h", 1, 2)).withColumn("end", F.sum("size").over(inner)).alias("r").join(
        base.alias("x"), F.expr("r.source <=> x.s and r.part = x.part")).selectExpr(
        "doc_id", "source", "size", "mark", "h", "source_size", "budget", "target", "base + end as end")
    ends = shelf.put(ends, "ends")

    times = F.expr(f"transform(sequence(0, {rounds - 1}), k -> (k * source_size + end) / target)")
    copies = ends.where("size > 0 and target > 0").select("doc_id", "h", "size", "budget", F.posexplode(times).alias("k", "finish"))
    copies = copies.withColumn("slice", F.expr(f"cast(floor({TIMES} * (finish / (1 + finish))) as int)"))
    upto = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    cut = copies.groupBy("slice").agg(F.sum("size").alias("n"), F.first("budget").alias("budget")).withColumn(
        "upto", F.sum("n").over(upto)).where("upto > budget").orderBy("slice").select("slice", F.expr("upto - n").alias("b")).first()
    place = F.struct("finish", "h", F.coalesce("doc_id", F.lit(-1)), "k")
    if cut is None:  # the budget is not reached
        taken = F.expr(f"if(size > 0 and target > 0, {rounds}, 0)")
    else:
        order = Window.orderBy("finish", "h", "doc_id", "k").rowsBetween(Window.unboundedPreceding, 0)
        last = copies.where(F.col("slice") == cut["slice"]).withColumn("upto", F.sum("size").over(order) + F.lit(cut["b"])).where(
            "upto <= budget").agg(F.max(place).alias("p"), F.max("budget")).first()["p"]
        if last is None:  # the cut lies between two slices
            taken = F.size(F.filter("finish", lambda v: F.expr(f"{TIMES} * 1L") * (v / (1 + v)) < F.lit(cut["slice"])))
        else:
            limit = F.struct(*[F.lit(v).cast(kind) for v, kind in zip(last, ("double", "string", "long", "int"))])
            taken = F.size(F.filter("finish", lambda v, k: F.struct(
                v, F.col("h"), F.coalesce("doc_id", F.lit(-1)).cast("long"), k) <= limit))
        taken = F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(F.lit(0))
    return ends.withColumn("finish", times).withColumn("copies", taken.cast("int")).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
        F.slice("finish", 1, "copies").alias("finish"), "mark")


def mixed(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.0, rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, text and any others) that the mix holds, once for each copy,
    sorted over all parts by virtual finish time. Rows whose text has no words are never in the mix. Every row
    has a decision of its own, whatever ids are repeated or null. Other columns may have any names."""
    p, at, nth = (free_name(docs, x) for x in ("plan", "finish", "nth"))
    rows, own = queued(docs, Shelf(docs.sparkSession), weights, share, rounds), ["doc_id", "source", "mark"]
    plan, held = rows.where("taken > 0").select(*own, "finish"), docs
    on = F.col("doc_id").eqNullSafe(F.col(f"{p}.doc_id")) & F.col("source").eqNullSafe(F.col(f"{p}.source")) & (
        F.xxhash64("text") == F.col(f"{p}.mark"))
    if not rows.where("size > 0").groupBy(*own).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        # Rows alike in all three are told apart by their number: the first ones get the earliest copies.
        plan = plan.withColumn("nth", F.row_number().over(Window.partitionBy(*own).orderBy("finish")))
        held = docs.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", "source", F.xxhash64("text")).orderBy("doc_id")))
        on = on & (F.col(nth) == F.col(f"{p}.nth"))
    held = held.join(plan.select(F.struct(*plan.columns).alias(p)), on)
    return held.select(*docs.columns, F.explode(f"{p}.finish").alias(at)).repartitionByRange(at, "doc_id").sortWithinPartitions(
        at, "doc_id").select(*docs.columns)
