"""Product codes of integer vectors, with distances from per-dimension dictionaries of values.

Vectors are cut into equal parts, each part position has a codebook, and a part is told by the number of
its nearest entry. Rows are stored once in blocks: for each dimension the distinct integers of the block
(its dictionary), and for each row the place of its value there. In a round the squared differences of
every distinct integer to all entries are tabulated for each dimension, so the distances of a part are
gathers from those tables by the rows' places, added over the part's dimensions. Every task adds up its
rows for each entry, and only those sums (entries times dimensions) meet in the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.whole_vectors import whole_vectors
from spanledger.operators.support import Shelf

PARTS, ENTRIES, ROUNDS = 16, 64, 2
BLOCK = 8192  # rows of a block
TILE = 1024  # rows whose distances are held at once
SALTS = 8
PACKED = "ids array<long>, labels array<long>, counts array<int>, dictionary array<int>, places binary"


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as the rows of a matrix; short ones end in zeros."""
    out = np.zeros((len(column), width), np.int64)
    at = column.offsets.to_numpy().astype(np.int64)
    size = np.diff(at)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], size)] = column.flatten().to_numpy()
    return out


def _pack(width: int):
    """Blocks of (vec_id, label, v): for each dimension its distinct values and each row's place among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                piece = b.slice(i, BLOCK)
                if n and n + piece.num_rows > BLOCK:
                    yield _block(pa.Table.from_batches(held).combine_chunks(), width)
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if n:
            yield _block(pa.Table.from_batches(held).combine_chunks(), width)
    return run


def _block(rows: pa.Table, width: int) -> pa.RecordBatch:
    v = matrix(rows.column("v").combine_chunks(), width)
    values, places = [], np.empty((width, len(v)), "<u2")  # a block has fewer rows than 2**16
    for d in range(width):
        own, places[d] = np.unique(v[:, d], return_inverse=True)
        values.append(own)
    one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
    whole = lambda name: one(rows.column(name).combine_chunks())
    return pa.RecordBatch.from_arrays([
        whole("vec_id"), whole("label"), one(pa.array([len(x) for x in values], pa.int32())),
        one(pa.array(np.concatenate(values) if values else [], pa.int32())), pa.array([places.tobytes()], pa.binary())],
        ["ids", "labels", "counts", "dictionary", "places"])


def nearest(values: list[np.ndarray], places: np.ndarray, books: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts): the nearest entry of each part and its squared distance, ties to the lower entry.

    ``books`` is (dimensions, entries). The tables hold all squared differences of a dimension's values.
    """
    width, entries = books.shape
    rows, size = places.shape[1], width // parts
    code, error = np.zeros((rows, parts), np.int64), np.zeros((rows, parts), np.int64)
    most = max([int(np.abs(x).max()) for x in values if len(x)] + [int(np.abs(books).max(initial=0))], default=0)
    kind = np.int32 if size * (2 * most) ** 2 < 1 << 31 else np.int64
    for p in range(parts):
        tables = [((values[d][:, None] - books[d][None, :]) ** 2).astype(kind) for d in range(p * size, (p + 1) * size)]
        for i in range(0, rows, TILE):
            end = min(i + TILE, rows)
            far = np.zeros((end - i, entries), kind)
            for d, table in zip(range(p * size, (p + 1) * size), tables):
                far += table.take(places[d, i:end], axis=0)
            best = far.argmin(axis=1)
            code[i:end, p], error[i:end, p] = best, far[np.arange(end - i), best]
    return code, error


def _blocks(batches: Iterator[pa.RecordBatch], width: int):
    """(ids, labels, values, places) of each stored block."""
    for b in batches:
        for i in range(b.num_rows):
            at = np.concatenate(([0], np.cumsum(b.column(2)[i].values.to_numpy())))
            every = b.column(3)[i].values.to_numpy().astype(np.int64)
            yield b.column(0)[i].values, b.column(1)[i].values, [every[x:y] for x, y in zip(at, at[1:])], \
                np.frombuffer(b.column(4)[i].as_buffer(), "<u2").reshape(width, -1)


def _sums(books: np.ndarray, parts: int):
    """(dimension, entry, n, total) over the rows of a task."""
    width, entries = books.shape
    size = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((width, entries), np.int64), np.zeros((width, entries), np.int64)
        for _, _, values, places in _blocks(batches, width):
            code, _ = nearest(values, places, books, parts)
            for d in range(width):
                own = code[:, d // size]
                n[d] += np.bincount(own, minlength=entries)
                # Exact: a block's sum stays far below 2**53.
                total[d] += np.bincount(own, weights=values[d][places[d]], minlength=entries).astype(np.int64)
        d, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(e), pa.array(n[d, e]), pa.array(total[d, e])],
                                         ["dimension", "entry", "n", "total"])
    return run


def _codes(books: np.ndarray, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, values, places in _blocks(batches, len(books)):
            code, error = nearest(values, places, books, parts)
            text = code.astype(np.uint8).tobytes().hex().encode()
            ends = np.arange(len(code) + 1, dtype=np.int32) * (2 * parts)
            yield pa.RecordBatch.from_arrays([
                ids, labels, pa.StringArray.from_buffers(len(code), pa.py_buffer(ends), pa.py_buffer(text)),
                pa.array(error.sum(axis=1))], ["vec_id", "label", "code", "error"])
    return run


def trained(blocks: DataFrame, first: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (dimensions, entries) after the rounds; an entry that no part is nearest to stays."""
    books = first
    for _ in range(rounds):
        sums = blocks.mapInArrow(_sums(books, parts), "dimension long, entry long, n long, total long").groupBy(
            "dimension", "entry").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        books = books.copy()
        for r in sums:
            books[r["dimension"], r["entry"]] = r["total"] // r["n"]
    return books


def vector_codes(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of each row with a whole vector.

    Integers and dropped rows are those of ``whole_vectors``. Vectors shorter than the longest one, or than
    the next multiple of ``parts``, end in zeros. The codebooks start from the ``entries`` rows of the least
    keys (at most 256), null keys last, rows with one key in the order of their vectors; fewer rows make
    fewer entries. ``label`` is a whole number; nulls are one label. Repeated rows are coded each. Other
    columns are ignored; without rows there are no results.
    """
    shelf = Shelf(rows.sparkSession)
    named = whole_vectors(rows.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                                      F.col(vector).alias("_vector")), "_vector")
    start = named.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    longest = named.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0
    width = max(-(-longest // parts), 1) * parts
    first = np.zeros((width, len(start)), np.int64)
    for e, r in enumerate(start):
        first[:len(r["v"]), e] = r["v"]
    blocks = shelf.put(named.mapInArrow(_pack(width), PACKED), "blocks")
    books = trained(blocks, first, parts, rounds) if start else first
    # By part, entry, and position within the part.
    told = books.reshape(parts, width // parts, len(start)).transpose(0, 2, 1).ravel().tolist()
    digest = hashlib.sha256(",".join(map(str, told)).encode()).hexdigest()
    coded = shelf.put(blocks.mapInArrow(_codes(books, parts), "vec_id long, label long, code string, error long"), "coded")
    # A label may be that of a third of all rows, so the totals meet the rows in salted parts.
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(
        "label", "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return salted.alias("c").join(totals.alias("t"), F.expr("c.label <=> t.label and c.salt = t.salt")).select(
        "vec_id", "c.label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
