"""Near-duplicate groups: fast similarity sketches, banding, exact verification on full shingle sets.

1. Each text becomes its set of distinct 5-word shingles and a sketch of 128 bins filled by rounds of hashed
   placement; 32 bands of four bins follow (a pair of similarity 0.75 shares no band with odds of 5e-6).
2. Texts with equal sets are one class, so exact copies never meet in pairs.
3. In a bucket (classes with one band in common) every class is verified against the least one, which is
   linear in the bucket. What is linked there is settled.
4. Buckets that still hold several components are finished exactly: the classes in them are joined on the
   rarest quarter of their shingles (two sets of similarity 0.75 must share one there), with bounds from
   size and position, and only between different components. So neither a large family of copies nor a
   passage that many texts share is expanded into its pairs, and no link is lost but those of pairs that share
   no band at all (5 in a million at 0.75) and are not reached over other links either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm import textscan as T
from spanledger.llm.components import components
from spanledger.llm.order import free_name
from spanledger.operators.support import Shelf

WORDS, BINS, BANDS = 5, 128, 32
AGREE, OF = 75, 100  # linked if OF * intersection >= AGREE * union
STEP = 1.05  # ratio of neighbouring size classes in the prefix join


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, d1, d2, bands) of each text."""
    rows = BINS // BANDS
    for b in T.pieces(batches, "text"):
        data, at = T.utf8(b.column(1))
        sets = T.shingles(*T.word_hashes(data, at), WORDS)
        sketch = T.fast_sketch(sets, BINS).reshape(len(sets), BANDS, rows)
        bands = T.mix((sketch * T.PLACE[:rows]).sum(axis=2) + T.PLACE[None, 16:16 + BANDS])
        all_, owner = T.joined(sets)
        sums = np.zeros((2, len(sets)), np.uint64)
        np.add.at(sums[0], owner, T.mix(all_))
        np.add.at(sums[1], owner, T.mix(all_ ^ T.PLACE[60]))
        yield pa.RecordBatch.from_arrays([
            b.column(0), pa.array(np.fromiter(map(len, sets), np.int64, len(sets))),
            pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
            pa.FixedSizeListArray.from_arrays(pa.array(bands.reshape(-1).view(np.int64)), BANDS)
            .cast(pa.list_(pa.int64()))], ["doc_id", "n", "d1", "d2", "bands"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, n, elements) of each text: its sorted distinct shingles as bytes."""
    for b in T.pieces(batches, "text"):
        data, at = T.utf8(b.column(1))
        sets = T.shingles(*T.word_hashes(data, at), WORDS)
        yield pa.RecordBatch.from_arrays([
            b.column(0), pa.array(np.fromiter(map(len, sets), np.int64, len(sets))),
            pa.array([s.tobytes() for s in sets], pa.binary())], ["c", "n", "elements"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sets ea and eb are similar enough."""
    for b in T.pieces(batches, "ea"):
        keep = np.zeros(b.num_rows, bool)
        for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if OF * min(len(x), len(y)) >= AGREE * max(len(x), len(y)):
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = common > 0 and OF * common >= AGREE * (len(both) - common)
        yield b.select([0, 1]).filter(pa.array(keep))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, n, e): a row for each shingle."""
    for b in T.pieces(batches, "elements"):
        data, at = T.utf8(b.column(2))
        n = (at[1:] - at[:-1]) // 8
        pick = pa.array(np.repeat(np.arange(b.num_rows), n))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick),
                                          pa.array(np.frombuffer(data.tobytes(), np.int64))], ["c", "n", "e"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked. A class with very many partners is met in several salted parts.

    The joins name their kind, so that they plan alike at every size.
    """
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / 2000).cast("int").alias("parts"))
    left = pairs.join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), "parts").cast("int"))
    one = sets.select(F.col("c").alias("a"), F.col("elements").alias("ea"))
    other = sets.join(salts.hint("shuffle_hash"), sets["c"] == salts["b"]).select(
        "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("elements").alias("eb"))
    met = left.select("a", "b", "salt").join(one.hint("merge"), "a").join(other.hint("merge"), ["b", "salt"])
    return met.select("a", "b", "ea", "eb").mapInArrow(_linked, "a long, b long").distinct()


def _prefix_pairs(sets: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs of classes in different components that may be linked, by the rarest shingles they share."""
    rows = sets.mapInArrow(_elements, "c long, n long, e long")
    often = rows.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    shared = rows.join(often, "e")
    of_class = "partition by c, n"
    ranked = shared.select("c", "n", "e", F.expr(f"n - count(*) over ({of_class})"
                                                 f" + row_number() over ({of_class} order by df, e) - 1").alias("r"))
    # A shingle at place r can be the first common one only if what follows can still reach the overlap
    # that the least partner asks for: n - r >= (t / (1 + t)) * (n + t * n), with t = AGREE / OF.
    prefix = ranked.where(f"{OF} * (n - r) >= {AGREE} * n").withColumn(
        "most", F.expr(f"floor((n - r) * {OF + AGREE} / {AGREE}) - n")).join(comp, "c")
    size = f"cast(floor(ln(%s) / ln({STEP})) as int)"
    # The members of the component that has most classes at a shingle are looked up, never look up.
    main = prefix.groupBy("e", "comp").agg(F.count("*").alias("k")).groupBy("e").agg(
        F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("k")).where("k > 1").drop("k")
    looked_up = prefix.select("e", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("most").alias("mb"),
                              F.col("comp").alias("cb"), F.expr(size % "n").alias("s"))
    asking = prefix.join(main, "e").where("comp <> main").select(
        "e", F.col("c").alias("a"), F.col("n").alias("na"), F.col("most").alias("ma"), F.col("comp").alias("ca"),
        F.explode(F.expr(f"sequence({size % f'greatest(1, floor(n * {AGREE} / {OF}))'}, "
                         f"{size % 'greatest(1, most, floor(n * %d / %d))' % (AGREE, OF)})")).alias("s"))
    met = asking.join(looked_up, ["e", "s"]).where(
        f"ca <> cb and nb <= ma and na <= mb and {OF} * least(na, nb) >= {AGREE} * greatest(na, nb)")
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    ``component_id`` is the least key reachable over links of similarity 0.75 or more. Rows with one key
    are one node: they are linked whatever their texts. A null or blank text has no shingles and no links;
    a text under five words is one shingle. A row without a key is linked with nothing: its component_id
    is null and it is kept. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = shelf.put(docs.mapInArrow(_sign, "doc_id long, n long, d1 long, d2 long, bands array<long>"), "signed")
    able = signed.where("doc_id is not null and n > 0")
    classes = shelf.put(able.groupBy("d1", "d2").agg(
        F.min("doc_id").alias("c"), F.min_by("bands", "doc_id").alias("bands")), "classes")
    member = able.select("doc_id", "d1", "d2").join(classes.select("d1", "d2", "c"), ["d1", "d2"]).select("doc_id", "c")
    twice = able.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    same_key = member.join(twice, "doc_id").where("doc_id <> c").select(F.col("doc_id").alias("a"), F.col("c").alias("b"))

    banded = classes.select("c", F.posexplode("bands").alias("band", "h")).select("c", F.xxhash64("h", "band").alias("h"))
    heads = banded.groupBy("h").agg(F.min("c").alias("least"), F.count("*").alias("k")).where("k > 1")
    buckets = shelf.put(banded.join(heads, "h").select("h", "c", "least", "k"), "buckets")
    stars = shelf.put(buckets.where("c <> least").select(F.col("c").alias("a"), F.col("least").alias("b")).distinct(), "stars")
    met = stars.select(F.col("a").alias("doc_id")).union(stars.select("b")).distinct()
    sets = shelf.put(docs.join(met.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_full_sets, "c long, n long, elements binary"), "sets")
    first = shelf.put(_verified(stars, sets).union(same_key), "first")

    roots = shelf.put(components(first, shelf, "one"), "roots")
    at = buckets.join(roots, buckets["c"] == roots["id"], "left").select("h", "c", "k", F.coalesce("root", "c").alias("comp"))
    split = at.where("k > 2").groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    open_ = shelf.put(at.join(split.select("h"), "h", "left_semi").select("c", "comp").distinct(), "open")
    rest = sets.join(open_.hint("shuffle_hash"), "c", "left_semi")
    more = _prefix_pairs(rest, open_).join(stars, ["a", "b"], "left_anti")
    second = _verified(shelf.put(more, "more"), sets)

    ends = components(first.union(second), shelf, "two")
    found = member.join(ends, member["c"] == ends["id"], "left").groupBy("doc_id").agg(
        F.min(F.coalesce("root", "c")).alias("component_id"))
    return signed.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all columns.

    Every row is a document of its own, whatever its key. Of a group stays the row with the least key that no
    other row has, else the first one stored of those that repeat a key or have none. Null and blank texts are
    linked with nothing and stay. Keys lie below 2**62; other columns may have any names.
    """
    shelf = Shelf(docs.sparkSession)
    row, twice = free_name(docs, "row_key"), free_name(docs, "key_twice")
    repeated = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(twice)).where(F.col(twice) > 1)
    own = F.when(F.col(key).isNotNull() & F.col(twice).isNull(), F.col(key).cast("long"))
    keyed = docs.join(shelf.put(repeated, "repeated"), key, "left").select(
        *docs.columns, F.coalesce(own, F.lit(1 << 62) + F.monotonically_increasing_id()).alias(row))
    keyed = shelf.put(keyed, "keyed")
    gone = near_duplicates(keyed, row, text).where("not kept").select(F.col("doc_id").alias(row))
    return keyed.join(shelf.put(gone, "gone"), row, "left_anti").select(*docs.columns)
