"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into blocks of 16 words; a passage is two blocks side by side, so any run of 17 words lies in
one. Passages and benchmark items are TF-IDF vectors over hashed words (document frequencies of the whole
corpus), projected onto a basis from a randomised SVD. A passage near an item is a candidate; around it the
longest common subsequence of words with the item is taken, and whether the item's answer, its last
sentence, stands there. Places that the cosine misses are candidates by an exact bound: a subsequence of 60 %
of an item's words holds some of its rarest words, and one of 45 % counts only with the whole answer, whose
first words are looked up. So every place with such a subsequence is compared. The items are a stated query set, sent to the tasks in blocks of bounded size, each
with a basis of its own that is fitted on all passages of its items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from spanledger.llm import textscan as T
from spanledger.llm.order import free_name
from spanledger.operators.support import Shelf

COLUMNS = 1 << 17  # hashed words
BLOCK = 16
RANK, MORE, ROUNDS = 64, 16, 2  # of the randomised SVD: kept, oversampled, power iterations
FIT_PASSAGES = 1024  # passages of the corpus that a basis is fitted on, beside all passages of the block's items
ALL = 1 << 40
BLOCKS = 2048  # blocks whose item words are counted at once
ITEMS = 2000  # items that are sought at once
COMMON = 0.4  # words with a lower inverse document frequency have no part in the vectors
NEAR = 0.55  # cosine of a candidate
LCS, LCS_WITH_ANSWER, ANSWER_WORDS = 0.6, 0.45, 4  # shares of the item's words
UNCOUNTED = 0.35  # share of an item's words, the commonest, that its bound leaves out; the bound is exact with any
PIECE = 256 << 10
AT_ONCE = 4  # blocks of items that are sought in one pass
HITS = "hits"
HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.bool_())]))
HITS_TYPE = ArrayType(StructType([StructField("item_id", LongType()), StructField("cosine", DoubleType()),
                                  StructField("lcs", DoubleType()), StructField("answer", BooleanType())]))


def _columns(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, before = T.word_hashes(data, at)
    return h, (h >> np.uint64(47)).astype(np.int64), before


def _scan(passages: int):
    """One pass over the texts: (c, n) for each hashed word and the number of texts that hold it, c = -1 for
    all texts, and as (h, columns) the passages with the least hashes of the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts, held, limit = np.zeros(COLUMNS, np.int64), 0, [], np.uint64(1 << 63)
        for b in T.pieces(batches, "text"):
            h, column, before = _columns(*T.utf8(b.column(0)))
            owner = np.repeat(np.arange(b.num_rows), np.diff(before))
            total += np.bincount(np.unique(owner * COLUMNS + column) % COLUMNS, minlength=COLUMNS)
            texts += b.num_rows
            begin, text = _blocks(before)
            end = np.minimum(begin + 2 * BLOCK, before[text + 1])
            mark = T.mix(h[begin] + (end - begin).astype(np.uint64)) >> np.uint64(1)
            low = np.flatnonzero(mark < limit)
            held += [(int(mark[i]), column[begin[i]:end[i]].tolist()) for i in low[np.argsort(mark[low], kind="stable")][:passages]]
            if len(held) > 4 * passages:
                held = sorted(held)[:passages]
                limit = np.uint64(held[-1][0] + 1)
        held, some = sorted(held)[:passages], np.flatnonzero(total)
        n = len(some) + 1
        yield pa.RecordBatch.from_arrays([
            pa.array([*some.tolist(), -1] + [None] * len(held), pa.int64()), pa.array([*total[some].tolist(), texts] + [None] * len(held), pa.int64()),
            pa.array([None] * n + [m for m, _ in held], pa.int64()), pa.array([None] * n + [c for _, c in held], pa.list_(pa.int64()))],
            ["c", "n", "h", "columns"])
    return run


def inverse_frequencies(scanned: DataFrame) -> np.ndarray:
    """log((1 + texts) / (1 + texts with the word)) by hashed word, over all texts; 0 for common words."""
    n, texts = np.zeros(COLUMNS), 0
    for r in scanned.where("c is not null").groupBy("c").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["c"] < 0:
            texts = r["n"]
        else:
            n[r["c"]] = r["n"]
    idf = np.log((1 + texts) / (1 + n)).astype(np.float32)
    return np.where(idf >= min(COMMON, idf.max(initial=0) / 2), idf, 0).astype(np.float32)


def _blocks(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each block, and the text it is in."""
    n = -(-np.diff(before) // BLOCK)
    text = np.repeat(np.arange(len(n)), n)
    first = np.arange(len(text)) - np.repeat(np.concatenate(([0], np.cumsum(n)))[:-1], n)
    return before[text] + BLOCK * first, text


class Space:
    """The latent space: ``place`` has the row of ``weights`` for each hashed word, or -1."""

    def __init__(self, place: np.ndarray, weights: np.ndarray):
        self.place, self.weights = place, weights

    def passages(self, column: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Vectors of the word spans, which follow each other; words outside the basis have no part in them."""
        row = self.place[column]
        live = np.flatnonzero(row >= 0)
        sums = np.zeros((len(begin), self.weights.shape[1]), np.float32)
        x, y = np.searchsorted(live, begin), np.searchsorted(live, end)
        some = np.flatnonzero(y > x)
        if len(some):
            sums[some] = np.add.reduceat(self.weights[row[live]], x[some], axis=0)
        return sums


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def basis(rows: DataFrame, idf: np.ndarray, rank: int = RANK) -> Space:
    """The leading right singular vectors of the rows' TF-IDF matrix, each over its singular value, so that what
    a language has in common does not make all its passages alike.

    Randomised subspace iteration: every round sends the current basis Q to the tasks, each returns its
    part of A'(A Q) for the words it holds, and the sum is made orthonormal again. ``rows`` are bounded in
    number, so their words, the only ones with a part in the basis, are too.
    """
    live = np.array([r[0] for r in rows.select(F.explode("columns").alias("c")).distinct().collect()], np.int64)
    live = np.sort(live[idf[live] > 0]) if len(live) else live
    place = np.full(COLUMNS, -1, np.int32)
    place[live] = np.arange(len(live))
    own, width = idf[live], min(rank + MORE, max(len(live), 1))
    q = np.random.default_rng(7).standard_normal((len(live), width)).astype(np.float32)

    def step(q: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(live), width), np.float32)
            for b in batches:
                for row in b.column(0).to_pylist():
                    c = place[np.asarray(row, np.int64)]
                    c, n = np.unique(c[c >= 0], return_counts=True)
                    v = own[c] * n
                    v = v / (np.linalg.norm(v) or 1.0)
                    total[c] += v[:, None] * (v @ q[c])
            some = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([x.tobytes() for x in total[some]], pa.binary())], ["c", "v"])
        out = np.zeros((len(live), width), np.float32)
        for r in rows.select("columns").mapInArrow(run, "c long, v binary").toLocalIterator():
            out[r["c"]] += np.frombuffer(r["v"], np.float32)
        return out
    if not len(live):
        return Space(place, np.zeros((0, rank), np.float32))
    for _ in range(ROUNDS):
        q = np.linalg.qr(step(q))[0].astype(np.float32)
    squares, u = np.linalg.eigh(q.T.astype(np.float64) @ step(q))
    u = u[:, ::-1][:, :rank] / np.sqrt(np.maximum(squares[::-1][:rank], 1e-3))
    return Space(place, np.ascontiguousarray(own[:, None] * (q @ u.astype(np.float32)), np.float32))


def lcs_length(a: list[int], b: list[int]) -> int:
    """Words of the longest common subsequence, by bits of one row."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for y in b:
        u = row & places.get(y, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def answer_words(text: str) -> int:
    """How many words the last sentence has; the whole text, where it is the only one, has no answer apart."""
    parts = [p for p in re.split(r"(?<=[.!?])[\s]+", text.strip()) if p.strip()]
    return len(parts[-1].split()) if len(parts) > 1 else 0


class Items:
    """A block of benchmark items: ids, word hashes, answers and latent vectors."""

    def __init__(self, rows: list, space: Space):
        raw = pa.array([r["text"] or "" for r in rows], pa.string())
        h, column, before = _columns(*T.utf8(raw))
        keep = [i for i in range(len(rows)) if before[i + 1] > before[i]]
        self.ids = [rows[i]["item_id"] for i in keep]
        self.words = [h[before[i]:before[i + 1]].tolist() for i in keep]
        # Answers shorter than ANSWER_WORDS prove nothing.
        self.answers = [w[-k:] if (k := answer_words(rows[i]["text"])) >= ANSWER_WORDS else [] for i, w in zip(keep, self.words)]
        self.vectors = unit(space.passages(column, before[:-1], before[1:])[keep])


class Bound:
    """What a place must hold of an item: ``need`` of its rarest words, or the first words of its answer.

    An LCS of 60 % leaves out at most ``spare`` of the item's words, so of its ``spare + need`` rarest ones
    at least ``need`` are there. Items are sorted by ``reach``, the blocks before and behind a place.
    """

    def __init__(self, items: Items, idf: np.ndarray):
        n = np.array([len(w) for w in items.words], np.int64)
        self.order = np.argsort(-(-n // BLOCK), kind="stable")
        self.reach = -(-n[self.order] // BLOCK)
        self.need = np.zeros(len(n), np.int32)
        held: dict[tuple[int, int], int] = {}
        starts: list[tuple[int, int]] = []
        for k, i in enumerate(self.order.tolist()):
            words = items.words[i]
            least = next(x for x in range(int(LCS * len(words)), len(words) + 1) if x / len(words) >= LCS)
            self.need[k] = max(1, least - int(UNCOUNTED * len(words)))
            rare = sorted(words, key=lambda x: (-idf[x >> 47], x))[:len(words) - least + int(self.need[k])]
            for x in rare:
                held[x, k] = held.get((x, k), 0) + 1
            if items.answers[i]:
                starts.append((int(_runs(np.array(items.answers[i][:ANSWER_WORDS], np.uint64))[0]), k))
        pairs = sorted(held)
        self.words, self.first = np.unique(np.array([x for x, _ in pairs], np.uint64), return_index=True)
        self.first = np.append(self.first, len(pairs))
        self.item, self.times = np.array([k for _, k in pairs], np.int64), np.array([held[p] for p in pairs], np.int64)
        starts.sort()
        self.starts, self.starter = np.array([x for x, _ in starts], np.uint64), np.array([k for _, k in starts], np.int64)

    def candidates(self, h: np.ndarray, before: np.ndarray, begin: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int]]:
        """(block, item) of all places of a piece that may hold the item."""
        m, wide = len(begin), len(self.order)
        if not m or not wide:
            return
        block = np.searchsorted(begin, np.arange(len(h)), side="right") - 1
        first, last = np.searchsorted(text, text), np.searchsorted(text, text, side="right")
        place = np.minimum(np.searchsorted(self.words, h), max(len(self.words) - 1, 0))
        live = np.flatnonzero(self.words[place] == h)
        key = np.unique(block[live] * len(self.words) + place[live])
        of, word = key // len(self.words), key % len(self.words)
        grams = _runs(h)
        i, j = np.searchsorted(self.starts, grams), np.searchsorted(self.starts, grams, side="right")
        opening = [(int(block[p]), int(k)) for p in np.flatnonzero(j > i) for k in self.starter[i[p]:j[p]]]
        groups = np.append(np.flatnonzero(np.diff(self.reach, prepend=-1)), wide).tolist()
        most = int(self.reach[-1])
        for p0 in range(0, m, BLOCKS):
            own = np.arange(p0, min(p0 + BLOCKS, m))
            low, high = max(p0 - most, 0), min(int(own[-1]) + 2 + most, m)
            i, j = np.searchsorted(of, (low, high))
            times = self.first[word[i:j] + 1] - self.first[word[i:j]]
            at = np.repeat(self.first[word[i:j]] - np.cumsum(times) + times, times) + np.arange(times.sum())
            total = np.zeros((high - low + 1, wide), np.int32)
            total[1:] = np.bincount(np.repeat(of[i:j] - low, times) * wide + self.item[at], self.times[at], (high - low) * wide).reshape(-1, wide)
            np.cumsum(total, axis=0, out=total)
            for a, b in zip(groups, groups[1:]):
                reach = int(self.reach[a])
                begins, ends = np.maximum(own - reach, first[own]) - low, np.minimum(own + 2 + reach, last[own]) - low
                for p, k in zip(*(x.tolist() for x in np.nonzero(total[ends, a:b] - total[begins, a:b] >= self.need[a:b]))):
                    yield p0 + p, int(self.order[a + k])
        for p, k in opening:
            reach = int(self.reach[k])
            for q in range(max(p - 2 - reach, int(first[p])), min(p + 2 + reach, int(last[p]))):
                yield q, int(self.order[k])


def _runs(h: np.ndarray) -> np.ndarray:
    """Hash of the ANSWER_WORDS words from each word on."""
    n = max(len(h) - ANSWER_WORDS + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(ANSWER_WORDS):
        out += h[j:n + j] * T.PLACE[j]
    return T.mix(out)


def _contains(words: list[int], part: list[int]) -> bool:
    return any(words[i:i + len(part)] == part for i, x in enumerate(words) if x == part[0])


def _search(sent, near: float, at: int, held: int, name: str):
    """The batches with the hits of each row in the last column. ``held`` is the place of earlier hits, or -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[tuple[Items, Bound, Space]] = sent.value
        for b in T.pieces(batches, "text", PIECE):
            h, column, before = _columns(*T.utf8(b.column(at)))
            begin, text = _blocks(before)
            hits: dict[int, list] = {}
            for items, bound, space in blocks:
                for t, hit in _hits(items, bound, space, near, h, column, before, begin, text):
                    hits.setdefault(t, []).append(hit)
            rows = [hits.get(t, []) for t in range(b.num_rows)]
            if held >= 0:
                rows = [x + y for x, y in zip(b.column(held).to_pylist(), rows)]
                b = b.remove_column(held)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, HIT)], [*b.schema.names, name])
    return run


def _hits(items: Items, bound: Bound, space: Space, near: float, h: np.ndarray, column: np.ndarray, before: np.ndarray,
          begin: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, dict]]:
    """(text, hit) for each item of a block that a text of the piece holds."""
    vectors = space.passages(column, begin, np.minimum(begin + BLOCK, before[text + 1]))
    beside = np.flatnonzero(text[1:] == text[:-1])
    halves = vectors.copy()
    vectors[beside] += halves[beside + 1]
    vectors = unit(vectors)
    best: dict[tuple[int, int], tuple[float, float, bool]] = {}
    pairs = set(bound.candidates(h, before, begin, text))
    for p0 in range(0, len(begin), 4096):
        p, i = np.nonzero(vectors[p0:p0 + 4096] @ items.vectors.T >= near)
        pairs.update(zip((p + p0).tolist(), i.tolist()))
    for p, i in sorted(pairs):
        t, word = int(text[p]), items.words[i]
        lo, hi = max(int(before[t]), int(begin[p]) - len(word)), min(int(before[t + 1]), int(begin[p]) + 2 * BLOCK + len(word))
        around = h[lo:hi].tolist()
        # No subsequence is longer than the item's words that are there at all.
        there = set(around)
        most, answer = sum(x in there for x in word) / len(word), items.answers[i]
        if most < LCS and (most < LCS_WITH_ANSWER or not answer or not there.issuperset(answer)):
            continue
        found = (lcs_length(word, around) / len(word), float(vectors[p] @ items.vectors[i]), bool(answer) and _contains(around, answer))
        if found[0] >= LCS or found[0] >= LCS_WITH_ANSWER and found[2]:
            best[t, i] = max(best.get((t, i), (0.0, 0.0, False)), found)
    for (t, i), (lcs, cosine, answer) in best.items():
        yield t, {"item_id": items.ids[i], "cosine": cosine, "lcs": lcs, "answer": answer}


def searched(docs: DataFrame, benchmark: DataFrame, near: float = NEAR) -> tuple[DataFrame, str]:
    """The rows of ``docs`` (text and any others) with their hits, and the name of that column.

    ``benchmark`` is (item_id, text). The whole of every text is searched, for all blocks of up to ``AT_ONCE``
    blocks of items in one pass; the rows are stored between passes. Every row is judged by its own text, so
    null or repeated ids make no difference. Null and blank texts and items hold nothing.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    texts = docs.select("text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    kinds = "c long, n long, h long, columns array<long>"
    scanned = shelf.put(texts.mapInArrow(_scan(FIT_PASSAGES), kinds), "scanned")
    idf = inverse_frequencies(scanned)
    passages = shelf.put(scanned.where("h is not null").orderBy("h").limit(FIT_PASSAGES).select("columns"), "passages")
    shelf.drop("scanned")
    parts = max(1, -(-items.count() // ITEMS))
    name, at, held = free_name(docs, HITS), docs.columns.index("text"), -1
    for first in range(0, parts, AT_ONCE):
        blocks = []
        for part in range(first, min(first + AT_ONCE, parts)):
            block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
            whole = block.select("text").mapInArrow(_scan(ALL), kinds).where("h is not null").select("columns")
            space = basis(shelf.put(whole.union(passages).repartition(4), "fit"), idf)
            shelf.drop("fit")
            own = Items(block.orderBy("item_id", "text").collect(), space)
            blocks.append((own, Bound(own, idf), space))
        sent = spark.sparkContext.broadcast(blocks)  # 34 MB a block at most, AT_ONCE blocks
        plain = [f for f in docs.schema.fields if f.name != name]
        docs = docs.mapInArrow(_search(sent, near, at, held, name), StructType([*plain, StructField(name, HITS_TYPE)]))
        held = len(plain)
        if first + AT_ONCE < parts:
            docs = shelf.put(docs, f"pass{first}")
    return docs, name


def contaminations(docs: DataFrame, benchmark: DataFrame, near: float = NEAR) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer): the items that a text holds, verbatim or paraphrased.

    ``docs`` is (doc_id, text). An item is held where the words of a place have an LCS of 60 % of the item's,
    or 45 % together with its answer. Rows with equal ids give their hits each.
    """
    rows, hits = searched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, near)
    return rows.select("doc_id", F.inline(hits))


def without_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text and any others) that hold no item, with all columns."""
    rows, hits = searched(docs, benchmark)
    return rows.where(F.size(hits) == 0).select(*docs.columns)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, kept, item_id, n_items, cosine, lcs, answer) for each row of ``docs``.

    The columns after ``kept`` tell of the item with the greatest LCS (then least id); null where there is none.
    A row without doc_id is judged by its text like any other. An empty table gives no rows.
    """
    rows, hits = searched(docs.select("doc_id", "text"), benchmark)
    best = F.array_max(F.transform(hits, lambda h: F.struct(h["lcs"], (-h["item_id"]).alias("least"), h["cosine"], h["answer"])))
    clean = F.size(hits) == 0
    return rows.select("doc_id", (~clean).alias("contaminated"), clean.alias("kept"), best.alias("b"),
                       F.size(F.array_distinct(F.transform(hits, lambda h: h["item_id"]))).cast("long").alias("n_items")).select(
        "doc_id", "contaminated", "kept", (-F.col("b.least")).alias("item_id"), "n_items", "b.cosine", "b.lcs", "b.answer")
