"""Vectors of floats as vectors of integers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
FURTHEST = (1 << 24) - 1  # integers beyond are held there, so that no sum or square leaves 64 bits


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows with ``v``, floor(256 * x) of each component as int, in place of the vector.

    Rows whose vector is null or holds a null, NaN or infinite component go. Components beyond +-65535 are
    held at the furthest integer. An empty vector stays empty.
    """
    x = F.col(vector).cast("array<double>")
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.least(F.greatest(c * SCALE, F.lit(-float(FURTHEST))), F.lit(float(FURTHEST)))
    return rows.where(sound).withColumn("v", F.transform(x, lambda c: F.floor(held(c)).cast("int"))).drop(vector)
