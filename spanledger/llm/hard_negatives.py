"""Hard negatives by exact inner products with subset-sum tables.

The components of a row are integers in two's complement. Eight dimensions make a group, and bit b of a
row's eight components makes one byte: the row is stored as bit planes of such bytes. For each anchor and
group a table has the sums of all 256 subsets of the anchor's eight components. The inner product is then
the table entries at a plane's bytes, added over the groups, shifted by the plane and added over the planes
(the sign plane is subtracted), without a multiplication.

Rows are packed into blocks where they are read. Anchors and blocks meet in groups of bounded size, twice:
first anchors with rows of their own label, for the positives, then with all rows, for the negatives of
each positive. A group hands on its best few; a window over those few picks the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.llm.vector_codes import matrix
from spanledger.llm.whole_vectors import whole_vectors
from spanledger.operators.support import Shelf

POSITIVES, NEGATIVES = 5, 10
LEAST, MOST = 30, 90  # a negative's score lies between these hundredths of the positive's
BLOCK = 4096  # rows of a block
GROUP_ROWS, GROUP_ANCHORS = 1 << 16, 1 << 14  # rows and anchors that meet in one task at a time
LANE, TILE = 64, 1024  # anchors and rows scored at once, so that tables and sums stay in the cache
NEVER = np.iinfo(np.int64).min
PACKED = "part long, ids array<long>, labels array<long>, bits int, planes binary"
IN_PART = (1 << 33) - 1


def bit_planes(v: np.ndarray) -> tuple[int, np.ndarray]:
    """The bits of the widest component with its sign, and the planes (bits, groups of eight, rows)."""
    bits = max(int(v.max(initial=0)), -int(v.min(initial=0)) - 1, 0).bit_length() + 1
    wide = np.zeros((len(v), -(-v.shape[1] // 8) * 8), np.int64)
    wide[:, :v.shape[1]] = v
    return bits, np.stack([np.packbits((wide >> b) & 1, axis=1, bitorder="little").T for b in range(bits)])


def subset_sums(anchors: np.ndarray, groups: int, kind: type) -> np.ndarray:
    """(groups, 256, anchors): the sum of each subset of each eight components."""
    wide = np.zeros((8 * groups, len(anchors)), kind)
    wide[:anchors.shape[1]] = anchors.T[:8 * groups]
    out = np.zeros((groups, 256, len(anchors)), kind)
    for j in range(8):
        out[:, 1 << j:2 << j] = out[:, :1 << j] + wide[j::8, None, :]
    return out


def scores(anchors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors): exact inner products of all rows behind the planes with all anchors."""
    bits, groups, rows = planes.shape
    furthest = int(np.abs(anchors).sum(axis=1).max(initial=0)) << bits
    kind = np.int32 if furthest < 1 << 31 else np.int64
    tables = subset_sums(anchors, groups, kind)
    out = np.empty((rows, len(anchors)), kind)
    seen = np.empty((min(TILE, rows), len(anchors)), kind)
    for i in range(0, rows, TILE):
        total = out[i:i + TILE]
        total[:] = 0
        gathered = seen[:len(total)]
        for b in range(bits - 1, -1, -1):
            total <<= 1
            for g in range(groups):
                np.take(tables[g], planes[b, g, i:i + TILE], axis=0, out=gathered, mode="clip")
                total += gathered
            if b == bits - 1:
                np.negative(total, out=total)
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (vec_id, label, v), numbered in each partition."""
    part, held, n = TaskContext.get().partitionId(), [], 0

    def block():
        nonlocal part, held, n
        rows = pa.Table.from_batches(held).combine_chunks().sort_by([("label", "ascending"), ("vec_id", "ascending")])
        column = rows.column("v").combine_chunks()
        width = int(np.diff(column.offsets.to_numpy()).max(initial=0))
        bits, planes = bit_planes(matrix(column, max(width, 1)))
        one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c.combine_chunks())
        out = pa.RecordBatch.from_arrays([
            pa.array([part], pa.int64()), one(rows.column("vec_id")), one(rows.column("label")),
            pa.array([bits], pa.int32()), pa.array([planes.tobytes()], pa.binary())], ["part", "ids", "labels", "bits", "planes"])
        part, held, n = part + 1, [], 0
        return out
    for b in batches:
        for i in range(0, b.num_rows, BLOCK):
            piece = b.slice(i, BLOCK)
            if n and n + piece.num_rows > BLOCK:
                yield block()
            held.append(piece)
            n += piece.num_rows
    if n:
        yield block()


def _block_rows(blocks: pa.Table):
    """(ids, is null, labels, place of each row by id with null last, planes) of each block."""
    for r in range(blocks.num_rows):
        ids = blocks.column("ids")[r].values
        null = ids.is_null().to_numpy(zero_copy_only=False)
        key = ids.fill_null(0).to_numpy()
        order = np.empty(len(ids), np.int64)
        order[np.lexsort((key, null))] = np.arange(len(ids))
        bits = blocks.column("bits")[r].as_py()
        planes = np.frombuffer(blocks.column("planes")[r].as_buffer(), np.uint8).reshape(bits, -1, len(ids))
        yield key, null, blocks.column("labels")[r].values.to_numpy(), order, planes


def ascending(score: np.ndarray, order: np.ndarray, out: np.ndarray, most: int | None = None):
    """Each line's scores from the worst to the best row, a smaller ``order`` being better among equals, and
    the rows' orders. Rows marked in ``out`` come first, with scores of NEVER. ``most`` keeps the last ones only.
    """
    n = int(order.max(initial=0)) + 1
    shift = n.bit_length()
    if score.size and int(np.abs(score).max()) < 1 << (62 - shift):
        both = (score.astype(np.int64) << shift) | (n - 1 - order)
        both[out] = NEVER
        if most is None:
            both.sort(axis=1)
        else:
            if most < both.shape[1]:
                both = np.partition(both, both.shape[1] - most, axis=1)[:, both.shape[1] - most:]
            both.sort(axis=1)
        return np.where(both == NEVER, NEVER, both >> shift), n - 1 - (both & ((1 << shift) - 1))
    score = np.where(out, NEVER, score.astype(np.int64))
    at = np.lexsort((np.broadcast_to(-order, score.shape), score), axis=1)[:, -(most or score.shape[1]):]
    return np.take_along_axis(score, at, 1), order[at]


def _vectors(anchors: pa.Table) -> np.ndarray:
    column = anchors.column("v").combine_chunks()
    return matrix(column, max(int(np.diff(column.offsets.to_numpy()).max(initial=0)), 1))


class Found:
    """Rows of whole numbers, the last column with nulls."""

    def __init__(self, *names: str):
        self.names, self.parts = names, [[] for _ in (*names, "null")]

    def add(self, *columns: np.ndarray) -> None:
        for held, c in zip(self.parts, columns):
            held.append(c)

    def table(self) -> pa.Table:
        *columns, null = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in self.parts]
        arrays = [pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.int64(), mask=null.astype(bool))]
        return pa.Table.from_arrays(arrays, list(self.names))


def _positives(k: int):
    def run(key, blocks: pa.Table, anchors: pa.Table) -> pa.Table:
        v, label = _vectors(anchors), anchors.column("label").to_numpy()
        number, own = anchors.column("a").to_numpy(), anchors.column("vec_id").to_numpy()
        by_label, found = np.argsort(label, kind="stable"), Found("a", "score", "id")
        same = np.split(by_label, np.flatnonzero(np.diff(label[by_label])) + 1) if len(label) else []
        for ids, null, labels, order, planes in _block_rows(blocks):
            row_at = np.argsort(order)
            for here in same:
                i, j = (int(np.searchsorted(labels, label[here[0]], side)) for side in ("left", "right"))
                for x in range(0, len(here) if i < j else 0, LANE):
                    some = here[x:x + LANE]
                    itself = (ids[i:j] == own[some, None]) & ~null[i:j]
                    score, place = ascending(scores(v[some], planes[:, :, i:j]).T, order[i:j], itself, k)
                    line, at = np.nonzero(score != NEVER)
                    row = row_at[place[line, at]]
                    found.add(number[some[line]], score[line, at], ids[row], null[row])
        return found.table()
    return run


def _negatives(k: int, least: int, most: int):
    def run(key, blocks: pa.Table, anchors: pa.Table) -> pa.Table:
        v, label, number = _vectors(anchors), anchors.column("label").to_numpy(), anchors.column("a").to_numpy()
        of, found = anchors.column("scores").to_pylist(), Found("a", "place", "score", "id")
        for ids, null, labels, order, planes in _block_rows(blocks):
            row_at = np.argsort(order)
            for x in range(0, len(v), LANE):
                some = np.arange(x, min(x + LANE, len(v)))
                score, place = ascending(scores(v[some], planes).T, order, labels == label[some, None])
                for i, line, at in zip(some.tolist(), score, place):
                    ends = line.searchsorted([most * p // 100 for p in of[i]], "right").tolist()
                    for turn, (p, end) in enumerate(zip(of[i], ends)):
                        begin = max(end - k, int(line[:end].searchsorted(max(-(-least * p // 100), NEVER + 1))))
                        if begin < end:
                            row = row_at[at[begin:end]]
                            found.add(np.full(end - begin, number[i]), np.full(end - begin, turn + 1), line[begin:end], ids[row], null[row])
        return found.table()
    return run


def _met(blocks: DataFrame, anchors: DataFrame, run, schema: str) -> DataFrame:
    """Every anchor meets every block, in groups of bounded numbers of both, dealt evenly over the tasks."""
    spark = blocks.sparkSession
    n, rows = blocks.agg(F.count("*"), F.sum(F.size("ids"))).first()
    cores = spark.sparkContext.defaultParallelism
    across = max(1, -(-(rows or 0) // GROUP_ROWS), min(n, 2 * cores))
    down = max(1, -(-anchors.count() // GROUP_ANCHORS))
    tasks = min(across * down, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = blocks.withColumn("s", F.pmod("part", F.lit(across)).cast("int")).withColumn("t", every(down))
    mine = F.pmod(F.shiftright("a", 33) + F.col("a").bitwiseAND(F.lit(IN_PART)), F.lit(down)).cast("int")
    right = anchors.withColumn("t", mine).withColumn("s", every(across))
    return left.repartition(tasks, "s", "t").groupBy("s", "t").cogroup(
        right.repartition(tasks, "s", "t").groupBy("s", "t")).applyInArrow(run, schema)


def hard_negatives(rows: DataFrame, anchors: Column, vector: str = "embedding", key: str = "vec_id", label: str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` tells by the key alone which rows are anchors. Integers are those of ``whole_vectors``; rows with
    a null label or without a whole vector take no part. An anchor's positives are the best rows of its
    label with another key; for each of them come the best rows of other labels whose score s has
    ``least`` * p <= 100 * s <= ``most`` * p, with p the positive's score. Ties go to the smaller key, a null key
    last (such rows are no anchors). Rows that repeat a key stand each for themselves. Vectors of unequal
    length meet as if the shorter ended in zeros. ``label`` is a whole number. Other columns are ignored;
    without rows, anchors or positives there are no results.
    """
    shelf = Shelf(rows.sparkSession)
    named = whole_vectors(rows.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                                      F.col(vector).alias("_vector")).where("label is not null"), "_vector")
    blocks = shelf.put(named.mapInArrow(_pack, PACKED), "blocks")
    chosen = named.where(F.col("vec_id").isNotNull() & anchors).withColumn("a", F.monotonically_increasing_id())
    asked = shelf.put(chosen, "anchors")
    best = Window.partitionBy("a").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    near = _met(blocks, asked, _positives(positives), "a long, score long, id long").withColumn(
        "place", F.row_number().over(best)).where(F.col("place") <= positives)
    lists = near.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("place", "score", "id"))).alias("near"))
    paired = shelf.put(asked.join(lists, "a"), "paired")
    hard = _met(blocks, paired.select("a", "label", "v", F.col("near.score").alias("scores")),
                _negatives(negatives, least, most), "a long, place long, score long, id long")
    best = Window.partitionBy("a", "place").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    first = hard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    of = paired.select("a", F.col("vec_id").alias("anchor_id"), F.posexplode("near").alias("at", "p"))
    return first.join(of.withColumn("place", (F.col("at") + 1).cast("long")).drop("at"), ["a", "place"]).select(
        "anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
