"""Dropping lines that many documents repeat, by probing sharded minimal perfect hashes.

One pass counts, for each distinct line key (two 64-bit hashes), the documents that hold it and the
largest of them. The keys over the limit are dealt into shards; each shard is stored as a minimal perfect
hash with arrays of fingerprints, counts and largest documents. A second pass over the texts probes those
arrays, so neither lines nor texts are joined or moved. A shard is loaded by address from the shared folder
where it is needed; a task holds few at once, however many there are.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm import textscan as T
from spanledger.llm.perfect_hash import MinimalHash
from spanledger.operators.support import Shelf

CHARS, DOCUMENTS = 40, 5
SHARD_KEYS = 50_000
PROBED = 8 << 20  # bytes of text that are probed together
HELD = 32  # shards that a task keeps
ARRAYS = "shard int, sizes array<long>, bits binary, fingerprints binary, counts binary, largest binary"


def _keys(batch: pa.RecordBatch, column: int, chars: int):
    """Lines of the texts, and the place, hashes and text number of those whose key is long enough."""
    data, at = T.utf8(batch.column(column))
    begin, end, before = T.lines(data, at)
    first, last = T.stripped(data, begin, end)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    long = np.flatnonzero(points[last] - points[first] >= chars)
    low, first, last = T.LOWER[data], first[long], last[long]
    h1 = T.span_hash(T.prefix_hash(low), first, last)
    h2 = T.span_hash(T.prefix_hash(low, T.OTHER_CODE), first, last, 1)
    return data, begin, end, before, long, h1, h2, np.searchsorted(before, long, side="right") - 1


def _held_keys(chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.pieces(batches, "text"):
            *_, h1, h2, owner = _keys(b, 1, chars)
            order = np.lexsort((h2, h1, owner))
            h1, h2, owner = h1[order], h2[order], owner[order]
            new = np.ones(len(order), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (owner[1:] != owner[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(h1[new].view(np.int64)), pa.array(h2[new].view(np.int64)),
                                              b.column(0).take(pa.array(owner[new]))], ["h1", "h2", "doc_id"])
    return run


def _shard_arrays(shard: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = (shard[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
    table = MinimalHash.build(h1, h2)
    order = np.argsort(table.number(h1, h2))
    counts = np.minimum(shard["n"].to_numpy(np.int64), 2**32 - 1).astype("<u4")
    return pd.DataFrame([{"shard": int(shard["shard"].iloc[0]), "sizes": table.sizes, "bits": table.packed(),
                          "fingerprints": h2[order].astype("<u8").tobytes(), "counts": counts[order].tobytes(),
                          "largest": shard["largest"].to_numpy("<i8")[order].tobytes()}])


class Shards:
    """The stored arrays, loaded shard by shard and dropped again when others are needed."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards, self.kept = folder, shards, OrderedDict()

    def _load(self, shard: int):
        if shard not in self.kept:
            system, root = pa.fs.FileSystem.from_uri(self.folder)
            files = [f.path for f in system.get_file_info(pa.fs.FileSelector(f"{root}/shard={shard}", allow_not_found=True))
                     if f.path.endswith(".parquet")]
            rows = pa.dataset.dataset(files, filesystem=system, format="parquet").to_table().to_pylist() if files else []
            self.kept[shard] = rows and (MinimalHash(rows[0]["sizes"], rows[0]["bits"]), np.frombuffer(rows[0]["fingerprints"], "<u8"),
                                         np.frombuffer(rows[0]["largest"], "<i8"))
            if len(self.kept) > HELD:
                self.kept.popitem(last=False)
        self.kept.move_to_end(shard)
        return self.kept[shard]

    def largest(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are members, and the largest document of each."""
        member, top = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        shard = (h1 % np.uint64(self.shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            if held := self._load(s):
                own = order[cuts[s]:cuts[s + 1]]
                at = held[0].number(h1[own], h2[own])
                hit = (at >= 0) & (held[1][at] == h2[own])
                member[own[hit]], top[own[hit]] = True, held[2][at[hit]]
        return member, top


def _kept_texts(folder: str, shards: int, chars: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Shards(folder, shards)
        for b in T.pieces(batches, "text", PROBED):
            data, begin, end, before, long, h1, h2, owner = _keys(b, 1, chars)
            member, top = held.largest(h1, h2)
            ids = b.column(0)
            own = np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            unkeyed = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
            drop = np.zeros(len(begin), bool)
            drop[long[member & ((top != own[owner]) | unkeyed[owner])]] = True
            dropped = np.add.reduceat(drop, before[:-1], dtype=np.int64)
            raw, texts = data.tobytes(), []
            for i, (x, y) in enumerate(zip(before[:-1].tolist(), before[1:].tolist())):
                if dropped[i]:
                    stay = np.flatnonzero(~drop[x:y]) + x
                    texts.append(b"\n".join([raw[p:q] for p, q in zip(begin[stay].tolist(), end[stay].tolist())]))
                else:
                    texts.append(raw[begin[x]:end[y - 1]])
            told = pa.array([hashlib.sha256(t).hexdigest() for t in texts]) if digest else pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*[told if digest is False and c == 1 else b.column(c) for c in range(b.num_columns) if not (digest and c)],
                                              pa.array(np.diff(before)), pa.array(dropped), *([told] if digest else [])],
                                             [*([b.schema.names[0]] if digest else b.schema.names), "n_lines", "n_dropped", *(["kept_sha256"] if digest else [])])
    return run


def dedup_lines(docs: DataFrame, chars: int = CHARS, documents: int = DOCUMENTS, digest: bool = False) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) with repeated lines dropped, and n_lines, n_dropped.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least ``chars``
    code points in at least ``documents`` different doc_ids lose their lines except in the largest doc_id.
    With ``digest`` only (doc_id, n_lines, n_dropped, kept_sha256) come back. A null text is one empty line
    and becomes empty. Rows with one doc_id count once; a row without doc_id is never the largest. Columns
    named like the new ones are replaced; an empty table gives no rows.
    """
    spark, shelf = docs.sparkSession, Shelf(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest)
    held = docs.select("doc_id", "text").mapInArrow(_held_keys(chars), "h1 long, h2 long, doc_id long")
    often = shelf.put(held.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("largest"))
                      .where(F.col("n") >= documents), "often")
    shards = max(1, -(-often.count() // SHARD_KEYS))
    # The hash as an unsigned number, so that both sides take the same remainder.
    shard = F.expr(f"cast(pmod(pmod(h1, {shards}) + if(h1 < 0, {(1 << 64) % shards}, 0), {shards}) as int)")
    arrays = often.withColumn("shard", shard).groupBy("shard").applyInPandas(_shard_arrays, ARRAYS)
    arrays.write.partitionBy("shard").parquet(f"{shelf.root}/arrays")
    shelf.drop("often")
    kept = _kept_texts(f"{shelf.root}/arrays", shards, chars, digest)
    if digest:
        return docs.select("doc_id", "text").mapInArrow(kept, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(kept, f"{kinds}, n_lines long, n_dropped long")
