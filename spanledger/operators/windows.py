"""Running values, ranks and samples that never put a whole group into one task.

A key may hold a third of all rows, so windows over a key are done in two levels: rows
are windowed inside (key, bucket), where the bucket follows the order and bounds the
group; bucket totals, one row each, carry the state from bucket to bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], order: list[str], bucket: Column | str,
            sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None,
            last: dict[str, Column] | None = None) -> DataFrame:
    """Adds running sums and maxima up to the row, and the value of the row before.

    Keys must not be null, and ``bucket`` must not decrease along ``order``. ``last`` gives the previous row's value
    of an expression (null on a key's first row). Calls that follow each other should name
    a bucket column of the table: the rows then stay where the first call put them.
    """
    sums, maxes, last = sums or {}, maxes or {}, last or {}
    b = bucket if isinstance(bucket, str) else "_b"
    base = df if isinstance(bucket, str) else df.withColumn(b, bucket)
    for name, expr in {**sums, **maxes, **last}.items():
        base = base.withColumn(f"_x_{name}", expr)
    kept = [c for c in df.columns if c != b]
    pos = F.struct(*order)
    totals = base.groupBy(*keys, b).agg(
        *[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max(f"_x_{n}").alias(f"_t_{n}") for n in maxes],
        *[F.max_by(f"_x_{n}", pos).alias(f"_t_{n}") for n in last],
        F.count("*").alias("_rows"))
    over = Window.partitionBy(*keys).orderBy(b)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, b,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_c_{n}") for n in maxes],
        *[F.lag(f"_t_{n}").over(over).alias(f"_c_{n}") for n in last])
    inner = Window.partitionBy(*keys, b).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    local = base.select(
        *kept, b,
        *[F.sum(f"_x_{n}").over(upto).alias(f"_l_{n}") for n in sums],
        *[F.max(f"_x_{n}").over(upto).alias(f"_l_{n}") for n in maxes],
        *[F.lag(f"_x_{n}").over(inner).alias(f"_l_{n}") for n in last],
        F.row_number().over(inner).alias("_rn"))
    joined = local.join(carried, [*keys, b], "left")
    return joined.select(
        *df.columns,
        *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums],
        *[F.greatest(f"_l_{n}", f"_c_{n}").alias(n) for n in maxes],
        *[F.when(F.col("_rn") == 1, F.col(f"_c_{n}")).otherwise(F.col(f"_l_{n}")).alias(n)
          for n in last])


def ranked(df: DataFrame, keys: list[str], order: list[str], bucket: Column,
           name: str = "rank") -> DataFrame:
    """Exact rank from 1 of every row inside its key."""
    return running(df, keys, order, bucket, sums={name: F.lit(1).cast("bigint")})


def forward_fill(lines: DataFrame, file_keys: list[str], order: str, value: Column,
                 name: str) -> DataFrame:
    """The last non-null value at or before each line of its file.

    The group is one file, whose text came out of a single row, so it is bounded.
    """
    upto = (Window.partitionBy(*file_keys).orderBy(order)
            .rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(upto))


def first_per_group(df: DataFrame, keys: list[str], order: list, cap: int) -> DataFrame:
    """The first ``cap`` rows per key. Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= cap)


def stride_sample(df: DataFrame, group: str, key: str, stride: int = 7, cap: int = 20) -> DataFrame:
    """Every stride-th key in order up to ``cap`` per group; small groups whole.

    Only the first stride*(cap-1)+1 rows of a group can be drawn, so no group is ranked
    further than that; group sizes come from a plain count.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("group_size"))
    head = first_per_group(df, [group], [key], stride * (cap - 1) + 1)
    drawn = (F.col("group_size") <= cap) | ((F.col("position") - 1) % stride == 0)
    return head.join(sizes, group).where(drawn)


def cell_stride_sample(df: DataFrame, cell: list[str], order: list[str], bucket: Column,
                       least: int = 20, part: int = 100) -> DataFrame:
    """A fixed-stride sample of each cell: one in ``part`` of it, at least ``least`` rows."""
    sizes = df.groupBy(*cell).agg(F.count("*").alias("cell_size"))
    want = F.least("cell_size", F.greatest(F.lit(least), F.expr(f"cell_size div {part}")))
    sizes = sizes.withColumn("_want", want).withColumn(
        "step", F.expr("greatest(1, cell_size div _want)"))
    rows = ranked(df, cell, order, bucket).join(sizes.drop("_want"), cell)
    return rows.where((F.col("rank") - 1) % F.col("step") == 0)


def runs(df: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column,
         piece: int = 9) -> DataFrame:
    """Numbers the runs of equal values along each key, and cuts runs into pieces.

    Adds ``run_no`` and ``piece_no``, both from 1; a piece holds at most ``piece`` rows.
    """
    d = running(df.withColumn("_bucket", bucket), keys, order, "_bucket", last={"_prev": F.col(value)},
                sums={"_rank": F.lit(1).cast("bigint")})
    start = F.when(F.col("_prev").eqNullSafe(F.col(value)), F.lit(0)).otherwise(1).cast("bigint")
    d = running(d.withColumn("_start", start), keys, order, "_bucket",
                sums={"run_no": F.col("_start")},
                maxes={"_run_start": F.when(F.col("_start") == 1, F.col("_rank"))})
    return d.withColumn("piece_no", F.expr(f"(_rank - _run_start) div {piece} + 1")).drop(
        "_prev", "_rank", "_start", "_run_start", "_bucket")


def window_counts(anchors: DataFrame, points: DataFrame, keys: list[str], pos: str,
                  before: int, after: int, bucket_width: int,
                  counted: dict[str, Column]) -> DataFrame:
    """For each anchor, sums over the points of its key within [pos-before, pos+after].

    A band join that emits no pairs: each anchor becomes two markers, and each sum is the
    running sum at its end marker less that at its start marker. ``anchors`` needs one row
    per (keys, pos).
    """
    names = list(counted)
    zero = [F.lit(0).cast("bigint").alias(n) for n in names]
    marks = points.select(*keys, F.col(pos).alias("_at"), F.lit(1).alias("_kind"),
                          F.col(pos).alias("_pos"),
                          *[counted[n].cast("bigint").alias(n) for n in names])
    for kind, shift in ((0, -before), (2, after)):
        marks = marks.unionByName(anchors.select(
            *keys, (F.col(pos) + shift).alias("_at"), F.lit(kind).alias("_kind"),
            F.col(pos).alias("_pos"), *zero))
    summed = running(marks, keys, ["_at", "_kind"], F.floor(F.col("_at") / bucket_width),
                     sums={f"_run_{n}": F.col(n) for n in names})
    ends = summed.where(F.col("_kind") != 1)
    return ends.groupBy(*keys, F.col("_pos").alias(pos)).agg(*[
        (F.max(F.when(F.col("_kind") == 2, F.col(f"_run_{n}")))
         - F.max(F.when(F.col("_kind") == 0, F.col(f"_run_{n}")))).alias(n) for n in names])
