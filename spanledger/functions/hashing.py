"""Content identifiers and order-free digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(text: Column, prefix: str = "ref-") -> Column:
    """A stable identifier: the prefix and 16 hex digits of the text's sha-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 16))


def text_key(text: Column) -> Column:
    """The whole sha-256 as 32 bytes: stands for a text where it is only grouped or joined,
    so that lines of any length cross the network as a short key."""
    return F.unhex(F.sha2(text, 256))


def key_id(key: Column, prefix: str = "ref-") -> Column:
    """The content identifier of the text a ``text_key`` stands for."""
    return F.concat(F.lit(prefix), F.lower(F.substring(F.hex(key), 1, 16)))


def canonical_text(df, columns=None) -> Column:
    """One row as text, which differs where rows differ.

    Columns stand by name; each value carries its length, so no text can pass for a null, a separator or
    the next column. Doubles are written with all digits that tell them from their neighbours.
    """
    types = dict(df.dtypes)
    return F.concat(*[F.concat(F.lit(name + "="), _framed(F.col(name), types[name]))
                      for name in sorted(columns or df.columns)])


def _framed(c: Column, dtype: str) -> Column:
    plain = _plain(c, dtype)
    return F.coalesce(F.concat(F.length(plain).cast("string"), F.lit(":"), plain), F.lit("-"))


def _plain(c: Column, dtype: str) -> Column:
    if dtype.startswith("timestamp"):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if dtype.startswith("array<"):
        inner = dtype[len("array<"):-1]
        return F.array_join(F.transform(c, lambda x: _framed(x, inner)), "")
    return c.cast("string")


def digest_sums(row_text: Column) -> list[Column]:
    """Aggregates that identify a multiset of rows whatever its order.

    Each row's sha-256 is cut into four 60-bit numbers which are summed, so the digest
    combines on the map side and never gathers the rows of a table anywhere.
    """
    digest = F.sha2(row_text, 256)
    sums = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))
            .cast("decimal(38,0)").alias(f"_h{i}") for i in range(4)]
    return [F.count(F.lit(1)).alias("_rows"), *sums]


def digest_of_sums() -> Column:
    """The hex digest from the columns made by ``digest_sums``."""
    parts = [F.col("_rows").cast("string")]
    parts += [F.coalesce(F.col(f"_h{i}").cast("string"), F.lit("0")) for i in range(4)]
    return F.sha2(F.concat_ws("|", *parts), 256)
