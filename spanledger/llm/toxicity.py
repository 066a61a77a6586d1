"""Toxicity of texts after noisy-channel deobfuscation.

Tokens that hold signs or digits between letters, letters three times running, or letters set apart are
read as a noisy form of a word: a lattice offers the letters each sign may stand for, or nothing, and
Viterbi decoding under a character trigram model of the whole corpus picks the likeliest reading. A sign
that sets letters apart may be nothing or the end of a word. The restored words join the text, and a logistic model on hashed words and stems scores the result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm import text_features as X
from spanledger.llm import textscan as T
from spanledger.llm.ordinal import learned, tails
from spanledger.operators.support import Shelf

THRESHOLD = 0.3
KINDS = 28  # end of word, a to z, other letters
NOTHING = -1
#: What a sign may stand for.
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
LEADING = {b"!": b"i", b"|": b"1"}  # signs that may be none before a word: it is read with their letter as well
SEPARATORS = ".-_*~ "
STAND, KEEP, DROP, REPEAT = -0.7, 0.0, -0.7, -0.5  # log odds of the channel's steps
LONGEST = 64  # bytes of a token whose reading is kept for the next time; longer ones are read anew
LETTERS, UNIT = rb"A-Za-z\x80-\xff", rb"(?:[A-Za-z01345789@$!|+]|[\xc2-\xf4][\x80-\xbf]+)"
NOISY = re.compile(rb"(?<![^\s])(?:" + UNIT + rb"(?:[ .\-_*~]" + UNIT + rb"){2,}(?![" + LETTERS + rb"0-9])"
                   rb"|[^\s]*(?:[" + LETTERS + rb"][0-9@$!|+.\-_*~]+[" + LETTERS + rb"]|[0-9@$!|+][" + LETTERS + rb"]{2}|([A-Za-z])\1\1)[^\s]*)")
_kind = np.zeros(256, np.int64)
_kind[97:123] = _kind[65:91] = np.arange(1, 27)
_kind[128:] = 27
KEPT_READINGS = 200_000


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(KINDS ** 3, np.int64)
    for b in T.pieces(batches, "text"):
        data, at = T.utf8(b.column(0))
        k = _kind[data]
        if len(k) > 2:
            total += np.bincount((k[:-2] * KINDS + k[1:-1]) * KINDS + k[2:], minlength=KINDS ** 3)
    code = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) over 28 kinds of characters, from the trigrams of all texts (add one half)."""
    rows = docs.select("text").mapInArrow(_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    n = np.full(KINDS ** 3, 0.5)
    for r in rows:
        n[r["code"]] += r["n"]
    n = n.reshape(KINDS, KINDS, KINDS)
    return np.log(n / n.sum(axis=2, keepdims=True))


def _lattice(token: str) -> Iterator[list[tuple[int, float, str]]]:
    """For each byte the (kind, log odds, text) it may be read as; kind 0 is the end of a word, -1 nothing at all."""
    before = ""
    for c in token:
        if c in STANDS_FOR:
            yield [(ord(x) - 96, STAND, x) for x in STANDS_FOR[c]] + ([(NOTHING, 2 * DROP, "")] if c in "!|" else [])
        elif "a" <= c <= "z":
            yield [(ord(c) - 96, KEEP, c)] + ([(NOTHING, REPEAT, "")] if before == c else [])
        elif c > "\x7f" and c.isalpha():
            # The model counts the bytes of other letters.
            yield [(KINDS - 1, KEEP, c)]
            yield from [[(KINDS - 1, KEEP, "")]] * (len(c.encode()) - 1)
        else:
            yield [(NOTHING, DROP, "")] + ([(0, DROP, " ")] if c in SEPARATORS else [])
        before = c


def _read(token: bytes, model: list[float]) -> str:
    """The likeliest reading by Viterbi over (last two kinds); each state has its odds and the way to it."""
    best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for options in _lattice(token.lower().decode(errors="ignore").lstrip(".,?;:").rstrip(".,!?;:")):
        step: dict[int, tuple[float, tuple | None]] = {}
        for state, (odds, way) in best.items():
            for kind, cost, text in options:
                if kind == NOTHING:
                    key, value = state, odds + cost
                else:
                    key, value = state % KINDS * KINDS + kind, odds + cost + model[state * KINDS + kind]
                if key not in step or value > step[key][0]:
                    step[key] = (value, (way, text) if text else way)
        best = step
    way, out = max(((odds + model[state * KINDS], state, way) for state, (odds, way) in best.items()), key=lambda x: x[:2])[2], []
    while way:
        way, text = way
        out.append(text)
    return "".join(reversed(out)).strip()


def restored(token: str, model: np.ndarray) -> str:
    """The likeliest reading of a noisy token, one word or several."""
    return _read(token.encode(), model.ravel().tolist())


class Restorer:
    def __init__(self, model: np.ndarray):
        self.model, self.known = model.ravel().tolist(), {}

    def text(self, raw: bytes) -> bytes:
        """The text, followed by the restored words. Email and web addresses are no words."""
        more = []
        for m in NOISY.finditer(raw):
            t = m[0]
            if b"://" in t or re.search(rb"@\w+\.\w", t) or not re.search(rb"[" + LETTERS + rb"]", t):
                continue
            read = self.known.get(t)
            if read is None:
                ways = [t, LEADING[t[:1]] + t[1:]] if t[:1] in LEADING else [t]
                read = " ".join(dict.fromkeys(_read(x, self.model) for x in ways)).encode()
                if len(self.known) > KEPT_READINGS:
                    self.known.clear()
                if len(t) <= LONGEST:
                    self.known[t] = read
            more.append(read)
        return raw + b" " + b" ".join(more) if more else raw


def _restored_column(text: pa.Array, restorer: Restorer) -> pa.Array:
    return pa.array([restorer.text(t or b"") for t in text.cast(pa.binary()).to_pylist()], pa.binary())


def held_out() -> "F.Column":
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


class Scorer:
    """Language model and weights, fitted once; ``column`` scores the texts of a batch."""

    def __init__(self, docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, rows: int = X.TRAINING_ROWS):
        """``labels`` is (doc_id, toxic); rows whose crc32(doc_id) mod 4 is 2 are not learned from."""
        shelf = Shelf(docs.sparkSession)
        self.model = model = language_model(docs if corpus is None else corpus)
        stored = X.training_rows(docs.where(~held_out()), labels.where(~held_out()).select("doc_id", F.col("toxic").alias("grade")))

        def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            restorer = Restorer(model)
            for b in T.pieces(batches, "text"):
                yield pa.RecordBatch.from_arrays([_restored_column(b.column(0), restorer).cast(pa.string()), b.column(1)], ["text", "grade"])
        stored = shelf.put(stored.mapInArrow(restore, "text string, grade long"), "fit")
        weights, self.thresholds = learned(stored, X.words_and_stems, 2, rows)
        if stored.isEmpty():
            self.thresholds = np.full(1, np.inf)
        self.places = np.flatnonzero(weights)
        self.values = weights[self.places]
        shelf.drop("fit")

    def batches(self, batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        restorer, weights = Restorer(self.model), np.zeros(X.BUCKETS)
        weights[self.places] = self.values
        for b in T.pieces(batches, "text"):
            yield b, tails(_restored_column(b.column(text), restorer), X.words_and_stems, weights, self.thresholds)[:, 0]


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = X.TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    Null and empty texts score as a text without words; where no text has a label to learn from, nothing is known to be
    toxic and every score is next to 0. Weights are those of all hashed words and stems that tell labels apart
    (``text_features.choose``); others weigh nothing. A noisy token is decoded whole, whatever its length.
    Ids, languages and sources are never inputs. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scorer = Scorer(docs, labels, rows=rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, p in scorer.batches(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], ["doc_id", "score"])
    return docs.mapInArrow(score, "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept_texts(docs: DataFrame, labels: DataFrame, rows: int = X.TRAINING_ROWS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that score under the threshold, with all columns. Without labels
    to learn from all rows stay."""
    scorer, at = Scorer(docs, labels, rows=rows), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, p in scorer.batches(batches, at):
            yield b.filter(pa.array(p < THRESHOLD))
    return docs.mapInArrow(keep, docs.schema)
