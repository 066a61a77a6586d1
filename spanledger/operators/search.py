"""The inverted index, its delta coding, and ranked search with and without it."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.operators.support import settled
from spanledger.operators.windows import first_per_group

TOKEN = r"[a-z0-9_.+-]+"
IN_TOKEN = np.array([bool(re.match(TOKEN, chr(b))) for b in range(256)])  # of bytes: tokens are ASCII
BLOCK = 4096
HELD = 16 << 20


def haystack(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def postings(frame: DataFrame, id_col: str, hay: str, *keep: str, min_len: int = 2) -> DataFrame:
    """Flat postings: one row per (token, row), tokens distinct inside the row."""
    toks = F.filter(F.array_distinct(F.regexp_extract_all(hay, F.lit(TOKEN), F.lit(0))),
                    lambda t: F.length(t) >= min_len)
    return frame.select(*keep, id_col, F.explode(toks).alias("token"))


def _cut(hays: pa.Array, most: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(tokens, offsets, rows) of texts: the distinct tokens with the rows that hold each, cut where they are more than ``most``."""
    hays = pc.fill_null(hays.cast(pa.binary()), b"")
    ends = np.frombuffer(hays.buffers()[1], np.int32)[hays.offset:hays.offset + len(hays) + 1]
    data = np.frombuffer(hays.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    inside = IN_TOKEN[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = ends[:-1][ends[:-1] < len(data)]
    first[starts] = inside[starts]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    places = np.flatnonzero(first)
    size = np.flatnonzero(last) - places + 1
    words = pa.StringArray.from_buffers(len(places), pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.py_buffer(data[inside])).dictionary_encode()
    row = np.repeat(np.arange(len(hays)), np.diff(np.searchsorted(places, ends)))
    pairs = np.sort(words.indices.to_numpy().astype(np.int64) * len(hays) + row)
    code, rows = np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], len(hays))
    counts = np.bincount(code, minlength=len(words.dictionary))
    pieces = -(-counts // most)
    token = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(len(token)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return words.dictionary.take(pa.array(token)), np.append((np.cumsum(counts) - counts)[token] + nth * most, len(rows)), rows


def posting_lists(frame: DataFrame, family: str, id_col: str, hay: str, most: int = BLOCK, held: int = HELD) -> DataFrame:
    """(family, token, n, ids as a list): the postings of tokens of any length, as lists from where they are cut.

    A task gives its lists out after ``held`` bytes of text, so that a token has one or more lists of at most ``most`` ids from it.
    """
    types = dict(frame.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: defaultdict = defaultdict(list)
        size = 0

        def given() -> Iterator[pa.RecordBatch]:
            for parts in texts.values():
                names, ids, hays = map(pa.concat_arrays, zip(*(p.columns for p in parts)))
                tokens, offsets, rows = _cut(hays, most)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), ids.take(pa.array(rows)))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.zeros(len(tokens), np.int64))), tokens, pa.array(np.diff(offsets)), lists],
                                                 [family, "token", "n", id_col])
            texts.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names = part.column(0).to_pylist()
                for name in set(names):
                    texts[name].append(part if names.count(name) == len(names) else part.take(pa.array([i for i, x in enumerate(names) if x == name])))
                size += pc.sum(pc.binary_length(part.column(2))).as_py() or 0
                if size >= held:
                    yield from given()
                    size = 0
        yield from given()

    return frame.select(family, id_col, hay).mapInArrow(run, f"{family} {types[family]}, token string, n long, {id_col} array<{types[id_col]}>")


def posting_blocks(flat: DataFrame, id_col: str, *keys: str, block: int = BLOCK) -> DataFrame:
    """Sorted posting lists cut at multiples of ``block`` ids.

    A list holds at most ``block`` ids however common the token is, and a reader that
    knows the ids it wants opens only their blocks.
    """
    return (flat.groupBy(*keys, "token", F.expr(f"{id_col} div {block}").alias("block_no"))
            .agg(F.array_sort(F.collect_list(id_col)).alias("postings"),
                 F.count("*").alias("n")))


def coded_blocks(blocks: DataFrame) -> DataFrame:
    """(token, block_no, postings, deltas) of sorted blocks: each posting's gap from the one before it in its token's whole list.

    Only the last id of a block goes from block to block.
    """
    last = blocks.select("token", "block_no", F.element_at("postings", -1).alias("_last"))
    carry = last.select("token", "block_no", F.lag("_last", 1, 0).over(Window.partitionBy("token").orderBy("block_no")).alias("_prev"))
    gaps = F.zip_with("postings", F.concat(F.array("_prev"), F.slice("postings", 1, F.size("postings") - 1)), lambda x, y: x - y)
    return blocks.join(carry, ["token", "block_no"]).select("token", "block_no", "postings", gaps.alias("deltas"))


def _unrolled(id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                token, base, ids, gaps = batch.slice(i, 256).columns
                size = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
                gap = gaps.flatten().to_numpy(zero_copy_only=False)
                upto = np.concatenate(([0], np.cumsum(gap)))
                shift = base.to_numpy(zero_copy_only=False) - upto[np.cumsum(size) - size]
                yield pa.RecordBatch.from_arrays([token.take(pa.array(np.repeat(np.arange(len(size)), size))), ids.flatten(), pa.array(gap),
                                                  pa.array(upto[1:] + np.repeat(shift, size))], ["token", id_col, "delta", "decoded"])
    return run


def decoded_blocks(coded: DataFrame, id_col: str) -> DataFrame:
    """(token, id, delta, decoded) of each posting: ids back from the gaps alone, by the blocks' sums and running sums inside a block."""
    sums = coded.select("token", "block_no", F.aggregate("deltas", F.lit(0).cast("long"), lambda a, x: a + x).alias("_sum"))
    before = Window.partitionBy("token").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("token", "block_no", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    return coded.join(base, ["token", "block_no"]).select("token", "_base", "postings", "deltas").mapInArrow(
        _unrolled(id_col), f"token string, {id_col} long, delta long, decoded long")


def _score(hay: Column, terms: list[str]) -> Column:
    total = F.lit(0)
    for t in terms:
        starts_word = hay.rlike(r"(?:^|[^a-z0-9])" + re.escape(t))
        total = total + F.when(hay.contains(t), F.when(starts_word, 3).otherwise(1))
    return total  # null as soon as one term is absent


def scored(frame: DataFrame, queries: list[str]) -> DataFrame:
    """(query, row, score) for every row that holds all terms of a query; one scan for all."""
    parts = [F.struct(F.lit(q).alias("query"), _score(F.col("hay"), q.lower().split()).alias("score"))
             for q in queries]
    hits = F.filter(F.array(*parts), lambda x: x["score"].isNotNull())
    return frame.select("kind", "id", "label", F.explode(hits).alias("h")).select(
        "h.query", "kind", "id", "label", "h.score")


def ranked_search(frame: DataFrame, queries: list[str], per_kind: int = 8) -> DataFrame:
    """The best rows per query and kind; a query without any hit gives one 'no-match' row."""
    best = first_per_group(scored(frame, queries), ["query", "kind"],
                           [F.col("score").desc(), F.col("id")], per_kind)
    # Kept once, so that the corpus is scored once for hits and misses alike.
    best = settled(best.select("query", "kind", "id", "label", "score", "position"))
    asked = frame.sparkSession.createDataFrame([(q,) for q in queries], "query string")
    none = asked.join(best.select("query").distinct(), "query", "left_anti").select(
        "query", F.lit("no-match").alias("kind"), F.lit("").alias("id"), F.lit("").alias("label"),
        F.lit(0).alias("score"), F.lit(0).alias("position"))
    return best.unionByName(none)


def index_search(index: DataFrame, frame: DataFrame, queries: list[str], id_cols: list[str], listed: str | None = None) -> DataFrame:
    """Rows of ``frame`` holding all terms of a query: candidates from postings, then their texts.

    ``listed`` names the id that ``index`` holds as lists; those of tokens with a piece are unpacked.

    A term is cut into tokens as the texts are; each piece lies inside a token of every row that holds
    the term, so only the postings of such tokens are read. Signs between tokens and the places of the
    pieces are verified on the candidates' ``hay``. The index holds tokens of every length (min_len=1).
    A query without any token character has every row as a candidate.
    """
    terms = {q: sorted(set(q.lower().split())) for q in queries}
    pieces = {q: sorted({p for t in ts for p in re.findall(TOKEN, t)}) for q, ts in terms.items()}
    wanted = [(q, p) for q in queries for p in pieces[q]]
    candidates = [frame.select(F.lit(q).alias("query"), *id_cols) for q in queries if not pieces[q]]
    if wanted:
        matches = F.filter(F.array(*[F.struct(
            F.lit(q).alias("query"), F.lit(p).alias("piece"), F.lit(len(pieces[q])).alias("n"),
            F.col("token").contains(p).alias("ok")) for q, p in wanted]), lambda x: x["ok"])
        any_piece = F.col("token").rlike("|".join(re.escape(p) for p in sorted({p for _, p in wanted})))
        hits = index.where(any_piece).select(*id_cols, F.explode(matches).alias("m")).select(*id_cols, "m.*")
        if listed:
            hits = hits.withColumn(listed, F.explode(listed))
        per_piece = hits.groupBy("query", "n", "piece", *id_cols).agg(F.lit(1).alias("_one"))
        candidates.append(per_piece.groupBy("query", "n", *id_cols).agg(F.count("*").alias("_have"))
                          .where(F.col("_have") == F.col("n")).select("query", *id_cols))
    found = reduce(DataFrame.union, candidates)
    holds = F.lit(False)
    for q, ts in terms.items():
        holds = F.when(F.col("query") == q, reduce(Column.__and__, [F.col("hay").contains(t) for t in ts], F.lit(True))).otherwise(holds)
    return frame.select(*id_cols, "hay").join(found, id_cols).where(holds).select("query", *id_cols)
