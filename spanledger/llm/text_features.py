"""Hashed features of texts, and the choice of those that tell labels apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm import textscan as T

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6)
TRAINING_ROWS = 20_000  # so many labelled rows at most are fitted by the driver; more are fitted by tasks
GAIN, TEXTS = 6, 3  # a feature with a gain at most this, or in fewer texts, is not told from chance
ID_BITS = 8  # bits for each graded id, by which texts without a grade are told
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True

Extract = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def distinct(owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(owner.astype(np.int64) * BUCKETS + feature)
    return key // BUCKETS, key % BUCKETS


def words_and_stems(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature): hashed words without signs at their ends, and their first 4, 5 and 6 bytes."""
    begin, end, before = T.spans(data, at)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = np.flatnonzero(LETTER[data])
    i, j = np.searchsorted(letters, begin), np.searchsorted(letters, end)
    some = j > i
    owner = np.repeat(np.arange(len(at) - 1), np.diff(before))[some]
    begin, end = letters[i[some]], letters[j[some] - 1] + 1
    prefix = T.prefix_hash(T.LOWER[data])
    out = [T.span_hash(prefix, begin, end)]
    out += [T.span_hash(prefix, begin, np.minimum(begin + k, end), k) for k in PREFIXES]
    feature = np.concatenate([(h >> np.uint64(46)).astype(np.int64) for h in out])
    return np.tile(owner, len(out)), feature


def shapes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature): how large a share of the words has each shape, in sixteenths; repeats; length."""
    begin, end, before = T.spans(data, at)
    n = np.diff(before)
    owner = np.repeat(np.arange(len(n)), n)
    count = lambda what: np.concatenate(([0], np.cumsum(what)))
    upper, digit = count((data >= 65) & (data <= 90)), count((data >= 48) & (data <= 57))
    letter = count(LETTER[data])
    size = end - begin
    up, num, let = upper[end] - upper[begin], digit[end] - digit[begin], letter[end] - letter[begin]
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    shape = ((up > 1).astype(np.int64) + 2 * (num > 0) + 4 * (let == 0) + 8 * (size - let > 1)
             + 16 * np.isin(last, np.frombuffer(b"!", np.uint8)) + 32 * np.isin(last, np.frombuffer(b"#*$%&|<>", np.uint8)) + 64 * (size > 24))
    table = np.bincount(owner * 128 + shape, minlength=128 * len(n)).reshape(len(n), 128)
    share = np.ceil(16 * table / np.maximum(n, 1)[:, None]).astype(np.int64)
    text, which = np.nonzero(table)
    words, _ = T.word_hashes(data, at)
    sets = T.shingles(words, before)
    again = np.array([max(k - 4, 1) - len(s) if k else 0 for k, s in zip(n.tolist(), sets)], np.int64)
    again = np.ceil(16 * again / np.maximum(n, 1)).astype(np.int64)
    own = np.arange(len(n))
    length = np.log2(np.maximum(n, 1) / 4 + 1).astype(np.int64)
    return (np.concatenate((text, own, own)),
            np.concatenate((which * 32 + share[text, which], 8192 + again, 8300 + np.minimum(length, 30))))


def _counts(extract: Extract, grades: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((grades, BUCKETS), np.int64)
        for b in T.pieces(batches, "text"):
            owner, feature = distinct(*extract(*T.utf8(b.column(0))))
            grade = b.column(1).to_numpy()
            for g in range(grades):
                total[g] += np.bincount(feature[grade[owner] == g], minlength=BUCKETS)
        grade, feature = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(grade), pa.array(total[grade, feature])], ["feature", "grade", "n"])
    return run


def _rows(extract: Extract, chosen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.pieces(batches, "text"):
            owner, feature = distinct(*extract(*T.utf8(b.column(0))))
            at = np.minimum(np.searchsorted(chosen, feature), max(len(chosen) - 1, 0))
            keep = chosen[at] == feature if len(chosen) else np.zeros(len(feature), bool)
            cuts = np.searchsorted(owner[keep], np.arange(b.num_rows + 1)).tolist()
            places = at[keep].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(
                [places[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())], ["grade", "have"])
    return run


def perhaps_in(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """All rows whose key is among ``ids``, and about one in nine of the others, told without moving the rows.

    Each id sets one of ``ID_BITS`` bits an id by its hash; pages of 32,768 bits are made by tasks and sent to all others,
    which is a byte for each id, whatever ids they are.
    """
    bits = max(ids.count(), 1) * ID_BITS
    bit = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(bits))
    pages = ids.select(bit.alias("_bit")).groupBy(F.expr("_bit div 32768").alias("_page")).agg(
        F.bitmap_construct_agg(F.expr("_bit % 32768")).alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit % 32768 div 8 as int) + 1, 1)")), 16, 10).cast("int")
    told = F.expr("_bit div 32768 = _page") & (F.call_function("getbit", byte, F.expr("cast(_bit % 8 as int)")) == 1)
    return rows.withColumn("_bit", bit).join(F.broadcast(pages), told).select(*rows.columns)


def training_rows(docs: DataFrame, grades: DataFrame) -> DataFrame:
    """(text, grade) of all graded documents; ``grades`` is (doc_id, grade), one row an id is used.

    Texts that surely have no grade are left where they are; the others are shuffled, however few the grades, so that
    the plan does not change with size.
    """
    some = grades.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("long").alias("grade"))
    near = perhaps_in(docs.select("doc_id", "text"), some, "doc_id")
    return near.join(some.hint("merge"), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "grade")


def choose(stored: DataFrame, extract: Extract, grades: int) -> np.ndarray:
    """All features whose presence tells the grades apart, however many there are.

    That is a test of each feature by itself: those in fewer than ``TEXTS`` texts, or with a gain in likelihood of at most
    ``GAIN``, are not told from chance. There are ``BUCKETS`` features at most, and the driver holds a number for each.
    """
    sizes = np.zeros(grades)
    for r in stored.groupBy("grade").count().collect():
        sizes[r["grade"]] = r["count"]
    counts = stored.mapInArrow(_counts(extract, grades), "feature long, grade long, n long").groupBy("feature").pivot(
        "grade", list(range(grades))).agg(F.sum("n")).na.fill(0)
    total = float(sizes.sum()) or 1.0
    named = [F.col(str(g)).cast("double") for g in range(grades)]
    held = sum(named[1:], named[0])
    gain = F.lit(0.0)
    for g in range(grades):
        for have, of in ((named[g], held), (F.lit(float(sizes[g])) - named[g], F.lit(total) - held)):
            gain = gain + F.when((have > 0) & (of > 0) & F.lit(sizes[g] > 0), have * F.log(have * total / (of * float(max(sizes[g], 1))))).otherwise(0.0)
    told = counts.where(held >= TEXTS).where(gain > GAIN).select("feature").toArrow()
    return np.sort(told["feature"].to_numpy().astype(np.int64))


def told_rows(stored: DataFrame, extract: Extract, chosen: np.ndarray) -> DataFrame:
    """(grade, have) of the training rows: ``have`` holds the places of a row's features as 32-bit integers."""
    return stored.mapInArrow(_rows(extract, chosen), "grade long, have binary")


def pairs(grade: pa.Array, have: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grades, and the (row, feature place) pairs of some rows."""
    have = have.to_pylist()
    at = np.repeat(np.arange(len(have), dtype=np.int32), [len(h) // 4 for h in have])
    return grade.to_numpy(zero_copy_only=False).astype(np.int64), at, np.frombuffer(b"".join(have), np.int32)


def matrix(told: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of all rows, whose number is bounded; the driver holds four bytes for each pair."""
    rows = told.select("grade", "have").toArrow().combine_chunks().sort_by([("grade", "ascending"), ("have", "ascending")])
    return pairs(rows["grade"], rows["have"])
