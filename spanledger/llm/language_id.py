"""Language of texts by cross-parsing: how few phrases of a language's sample make up the text.

For each language a suffix automaton holds every substring of a bounded sample of its labelled texts. A text
is parsed from the left: the longest match with the sample is one phrase, the next begins behind it, and a
letter that the sample lacks is a phrase of its own. Phrases times log2 of the sample's size over the text's
size is the cross-parsing entropy; the language with the least wins.

The automata of all languages become one table (state, letter) -> state that restarts at the root where
no match goes on and tells that a phrase begins. Texts are parsed in segments of bounded length, all
segments of a batch and all languages side by side, one letter a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.llm import textscan as T

ROWS = 400  # labelled rows of a language, those with the least hashes of their ids
WORDS, PASSAGES = 16, 200  # words of a passage, and passages of a language, those with the least hashes
PIECE, SEGMENT = 512 << 10, 512  # bytes handled at once, and bytes parsed in a row
UNKNOWN = "und"


def letters(text: Column) -> Column:
    """Words of lower-case letters between single spaces, with one at both ends; empty without a letter."""
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), F.concat(F.lit(" "), F.trim(words), F.lit(" "))).otherwise("")


def suffix_automaton(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transitions (from, letter, to) of the automaton of all substrings; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data.tolist():
        new, at = len(step), last
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at >= 0:
            to = step[at][c]
            if length[to] > length[at] + 1:
                twin = len(step)
                step.append(dict(step[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and step[at].get(c) == to:
                    step[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
            else:
                link[new] = to
        last = new
    size = np.fromiter(map(len, step), np.int64, len(step))
    return (np.repeat(np.arange(len(step)), size), np.fromiter((c for s in step for c in s), np.int64, size.sum()),
            np.fromiter((t for s in step for t in s.values()), np.int64, size.sum()))


class Parser:
    """Counts the phrases of texts in the samples of all languages."""

    def __init__(self, samples: tuple[bytes, ...]):
        raw = [np.frombuffer(s, np.uint8) for s in samples]
        used = np.flatnonzero(np.bincount(np.concatenate(raw), minlength=256)) if raw else np.zeros(0, np.int64)
        self.letter = np.full(256, len(used), np.int32)  # the last class is that of bytes in no sample
        self.letter[used] = np.arange(len(used))
        width, rows, roots = len(used) + 1, [], []
        for data in raw:
            state, c, to = suffix_automaton(self.letter[data])
            root, n = sum(map(len, rows)), int(state.max(initial=0) if not len(to) else max(state.max(), to.max())) + 1
            begin = np.full(width, root, np.int64)
            at_root = state == 0
            begin[c[at_root]] = root + to[at_root]
            table = np.tile(2 * width * begin + 1, (n, 1))
            table[state, c] = 2 * width * (root + to) + at_root
            roots.append(root * width)
            rows.append(table.astype(np.int32))
        self.table = np.concatenate(rows).ravel() if rows else np.zeros(0, np.int32)
        self.roots = np.array(roots, np.int32)

    def phrases(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(texts, languages): the phrases of each text, summed over its segments."""
        size = np.diff(at)
        parts = -(-size // SEGMENT)
        text = np.repeat(np.arange(len(size)), parts)
        begin = at[:-1][text] + SEGMENT * (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts))
        length = np.minimum(at[1:][text] - begin, SEGMENT)
        order = np.argsort(-length, kind="stable")
        text, begin, length = text[order], begin[order], length[order]
        letter = np.append(self.letter[data], np.int32(0))
        state = np.repeat(self.roots[:, None], len(text), axis=1)
        count = np.zeros(state.shape, np.int32)
        running = np.searchsorted(-length, -np.arange(length.max(initial=0)), "left")
        for t, n in enumerate(running.tolist()):
            moved = self.table.take(state[:, :n] + letter[begin[:n] + t])
            count[:, :n] += moved & 1
            np.right_shift(moved, 1, out=state[:, :n])
        out = np.zeros((len(size), len(self.roots)), np.int64)
        np.add.at(out, text, count.T)
        return out


@lru_cache(maxsize=2)
def parser(samples: tuple[bytes, ...]) -> Parser:
    return Parser(samples)


def samples(docs: DataFrame, key: str, text: str, lang: str, rows: int = ROWS, passages: int = PASSAGES) -> list[tuple[str, int, bytes]]:
    """(language, labelled rows, sample) of each language of ``docs``, in the order of the names.

    A sample is a bounded choice of passages of a bounded choice of rows. Passages found in two languages
    are in no sample.
    """
    known = docs.where(F.col(lang).isNotNull() & F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    counts = {r[lang]: r["n"] for r in known.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    first = Window.partitionBy(lang).orderBy(F.xxhash64(key), key, F.xxhash64(text))
    some = known.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= rows)
    words = F.split(F.trim(letters(F.col(text))), " ")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / WORDS)),
                       lambda i: F.array_join(F.slice(words, (i * WORDS + 1).cast("int"), WORDS), " "))
    once = some.select(F.col(lang).alias("lang"), F.explode(runs).alias("passage")).groupBy("passage").agg(
        F.min("lang").alias("lang"), F.max("lang").alias("other")).where("lang = other")
    few = Window.partitionBy("lang").orderBy(F.xxhash64("passage"), "passage")
    held: dict[str, list[str]] = {}
    for r in once.withColumn("_r", F.row_number().over(few)).where(F.col("_r") <= passages).select("lang", "passage", "_r").collect():
        held.setdefault(r["lang"], []).append((r["_r"], r["passage"]))
    return [(k, counts[k], (" " + " ".join(p for _, p in sorted(held[k])) + " ").encode()) for k in sorted(held)]


def language_ids(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
                 rows: int = ROWS, passages: int = PASSAGES) -> DataFrame:
    """(doc_id, lang_pred, score, phrases) of each row of ``docs``.

    ``learn`` tells by the key which labelled rows may be learned from. ``phrases`` maps the languages to the
    phrases of the text. Ties go to the language with more labelled rows, then to the first name. ``score`` is the
    winner's share when each phrase more than the winner's halves a language's weight. A text that is null or
    without a letter is ``und`` with score 0, and so is every text when nothing is learned. Repeated rows
    are judged each; other columns are ignored; an empty table gives no rows.
    """
    named = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    told = samples(docs.where(learn).select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"),
                                            F.col(lang).cast("string").alias("lang")), "doc_id", "text", "lang", rows, passages)
    told.sort(key=lambda x: (-x[1], x[0]))
    names, texts = [k for k, _, _ in told], tuple(s for _, _, s in told)
    bits = np.log2([max(len(s), 2) for s in texts])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(texts)
        for b in T.pieces(batches, "text", PIECE):
            data, at = T.utf8(b.column(1))
            n = own.phrases(data, at)
            some = np.diff(at) > 0
            if len(names):
                cost = n * bits  # the text's size is the same for all languages
                best = cost.argmin(axis=1)
                share = 1 / np.exp2(-(cost - cost.min(axis=1, keepdims=True)) / bits.mean()).sum(axis=1)
                pred = np.where(some, np.array(names, object)[best], UNKNOWN)
            else:
                pred, share = np.full(len(n), UNKNOWN, object), np.zeros(len(n))
            lists = pa.MapArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * len(names), pa.array(names * len(n), pa.string()), pa.array(n.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(np.where(some, share, 0.0)), lists],
                                             ["doc_id", "lang_pred", "score", "phrases"])
    kind = dict(named.dtypes)["doc_id"]
    return named.select("doc_id", letters(F.col("text")).alias("text")).mapInArrow(
        judge, f"doc_id {kind}, lang_pred string, score double, phrases map<string,long>")
