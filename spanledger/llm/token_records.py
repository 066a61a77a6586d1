"""Token ids in files of length-delimited records, with an offset index for shuffled reads.

A record is an 8-byte little-endian length, the masked CRC-32C of those 8 bytes, the payload, and the
masked CRC-32C of the payload. The payload holds one sequence of ids, 2 bytes each where the vocabulary
allows it, else 4. Every task writes one file, under a name of its own attempt, through the file system
that the folder's address names; the index (one row for each record) is an ordinary table and only
names files of tasks that succeeded, so repeated attempts leave nothing that is read.
"""

from __future__ import annotations

import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.llm import textscan as T
from spanledger.llm.crc32c import crc32c, masked
from spanledger.llm.order import part_offsets
from spanledger.operators.support import Shelf

FRAME = 8 + 4 + 4
INDEX = "place long, doc_id long, file string, at long, bytes long, n_tokens long, before long"
SIGNS = b".,;:!?%*$&#|"
SIGN, LETTER = np.zeros(256, bool), np.zeros(256, bool)
SIGN[list(SIGNS)] = LETTER[65:91] = LETTER[97:123] = True
MOST_KEPT = 600_000  # pieces of text whose ids a worker keeps
PIECE = 1 << 20  # bytes of text whose words are looked up together
READ = 1 << 20  # bytes of neighbouring records read at once; a longer record is read alone
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of whole texts by a tokenizer of the tokenizers library, each distinct piece between spaces only once.

    Right for tokenizers whose pre-tokenizer never joins characters across white space and removes it, and
    which treat a run of letters apart from signs behind it; ``checked`` tells whether one is of this kind.
    Others encode the whole text.
    """

    def __init__(self, path: str, end: int):
        import json
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16 else "<u4")
        self.end = np.array([end], self.kind)
        with open(path, encoding="utf-8") as f:
            self.by_piece = self.checked(json.load(f))
        self.kept: dict[bytes, bytes] = {}

    @staticmethod
    def checked(told: dict) -> bool:
        steps = told.get("pre_tokenizer") or {}
        steps = steps.get("pretokenizers", [steps])
        split = steps[0] if steps else {}
        return (split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
                and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in (split.get("pattern") or {}).get("Regex", "") and not told.get("post_processor")
                and all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") for s in steps[1:])
                and not any(t.get("lstrip") or t.get("rstrip") for t in told.get("added_tokens", ()))
                and [s.get("type") for s in (told.get("normalizer") or {}).get("normalizers", ())] == ["NFC", "Replace", "Lowercase"])

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.kind)

    def _ask(self, words: list[bytes]) -> None:
        """Ids of words that are runs of letters. Many, if each is one pre-token, share a call."""
        for i in range(0, len(words), 4000):
            some = words[i:i + 4000]
            told = self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False)
            ids, owner = np.array(told.ids, self.kind).tobytes(), np.array(told.word_ids, np.int64)
            cuts = np.searchsorted(owner, np.arange(len(some) + 1))
            if len(owner) and owner[-1] == len(some) - 1 and (np.diff(cuts) > 0).all():
                cuts = (cuts * self.kind.itemsize).tolist()
                self.kept.update((w, ids[a:b]) for w, a, b in zip(some, cuts, cuts[1:]))
            else:
                self._ask_each(some)

    def _ask_each(self, words: list[bytes]) -> None:
        told = self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)
        self.kept.update((w, np.array(e.ids, self.kind).tobytes()) for w, e in zip(words, told))

    @staticmethod
    def apart(core: str) -> bool:
        """Whether signs behind these letters are a pre-token of their own: as the normalizer leaves them, they
        must still be letters alone. Told for Latin, Greek and Cyrillic only; other words are encoded with their signs."""
        folded = unicodedata.normalize("NFC", core).lower()
        return folded.isalpha() and max(folded) < "\u0530"

    def _learn(self, new: list[bytes]) -> None:
        letters, other, signed = {}, {}, []
        for w in new:
            if w.isalpha() or not w.isascii() and w.decode().isalpha():
                letters[w] = None
                continue
            core = w.rstrip(SIGNS)
            if core and len(core) < len(w) and not core.isascii() and self.apart(core.decode()):
                letters[core] = other[w[len(core):]] = None
                signed.append((w, len(core)))
            else:
                other[w] = None
        kept = self.kept
        self._ask([w for w in letters if w not in kept])
        self._ask_each([w for w in other if w not in kept])
        kept.update((w, kept[w[:n]] + kept[w[n:]]) for w, n in signed)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind each other, each with the end id, and where each begins (len + 1).

        The words of the batch are cut before a sign behind A-Z, which no normalizer turns into anything but a
        letter, and looked up once for each distinct one. Case is folded before for A-Z only, and not in texts with
        combining marks (which may compose with a small letter alone). Texts that may hold special tokens are
        encoded whole.
        """
        data, at = T.utf8(column)
        owner = lambda places: np.unique(np.searchsorted(at, places, "right") - 1)
        special = owner(np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))) if self.by_piece else np.arange(len(column))
        marked = owner(np.flatnonzero((data == 0xCC) | (data == 0xCD)))
        folded = T.LOWER[data]
        for i in marked.tolist():
            folded[at[i]:at[i + 1]] = data[at[i]:at[i + 1]]
        for i in special.tolist():
            folded[at[i]:at[i + 1]] = 32
        begin, end, _ = T.spans(folded, at)
        cut = np.flatnonzero(SIGN[folded[1:]] & LETTER[folded[:-1]]) + 1
        cut = cut[~np.isin(cut, at)]
        begin, end = np.sort(np.concatenate((begin, cut))), np.sort(np.concatenate((end, cut)))
        offsets = np.concatenate(([0], np.cumsum(end - begin)))
        solid = folded[~T.SPACE[folded]]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(solid)])
        coded = words.dictionary_encode()
        own, ends = T.utf8(coded.dictionary)
        own, ends = own.tobytes(), ends.tolist()
        distinct = [own[a:b] for a, b in zip(ends, ends[1:])]
        if len(self.kept) > MOST_KEPT:
            self.kept = dict(islice(self.kept.items(), len(self.kept) // 2, None))
        self._learn([w for w in distinct if w not in self.kept])
        parts = [self.kept[w] for w in distinct]
        # Behind the distinct words stand the ids of the special texts, and the end id.
        parts += [self.whole(data[at[i]:at[i + 1]].tobytes()).tobytes() for i in special.tolist()] + [self.end.tobytes()]
        flat = np.frombuffer(b"".join(parts), self.kind)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.kind.itemsize
        start = np.cumsum(size) - size
        # The sequence of all parts: the words of each text (or itself, if special), then the end.
        n = np.diff(np.searchsorted(begin, at))
        item = np.insert(coded.indices.to_numpy().astype(np.int64), np.cumsum(n), len(parts) - 1)
        last = np.cumsum(n + 1) - 1
        if len(special):
            item = np.insert(item, last[special], len(distinct) + np.arange(len(special)))
            last = last + np.searchsorted(special, np.arange(len(n)), "right")
        total = np.cumsum(size[item])
        ids = flat[np.repeat(start[item] - total + size[item], size[item]) + np.arange(total[-1] if len(total) else 0)]
        return ids, np.concatenate(([0], total[last])) if len(n) else np.zeros(1, np.int64)


def encoder(path: str, end: int) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path, end)
    return _encoders[path]


def _framed(payload: bytes, cuts: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The records behind each other, and where each begins (len + 1)."""
    lengths = np.diff(cuts).astype("<u8")
    body = masked(crc32c(np.frombuffer(payload, np.uint8), cuts)).astype("<u4").tobytes()
    head = masked(crc32c(lengths.view(np.uint8), np.arange(0, 8 * len(lengths) + 1, 8))).astype("<u4").tobytes()
    told, ends = lengths.tobytes(), cuts.tolist()
    out = b"".join(x for i, (a, b) in enumerate(zip(ends, ends[1:])) for x in
                   (told[8 * i:8 * i + 8], head[4 * i:4 * i + 4], payload[a:b], body[4 * i:4 * i + 4]))
    return out, cuts + FRAME * np.arange(len(cuts))


def write_records(docs: DataFrame, by: list[Column], folder: str, tokenizer: str, end: int, shelf: Shelf) -> DataFrame:
    """Encode (doc_id, text) in the order of ``by`` into record files; returns the index, already stored."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(tokenizer, end), TaskContext.get().partitionId()
        system, root = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name, out = f"{root}/{part:06d}-{uuid.uuid4().hex}.records", None
        at = before = rows = 0
        for b in T.pieces(batches, "text", PIECE):
            ids, cuts = own.texts(b.column(1))
            data, places = _framed(ids.tobytes(), cuts * own.kind.itemsize)
            out = out or system.open_output_stream(name)
            out.write(data)
            n = np.diff(cuts)
            size = places[1:] - places[:-1]
            yield pa.RecordBatch.from_arrays([
                pa.array((part << 33) + rows + np.arange(len(n))), b.column(0), pa.array([name.rsplit("/", 1)[1]] * len(n)),
                pa.array(at + places[:-1]), pa.array(size), pa.array(n), pa.array(before + np.cumsum(n) - n)],
                ["place", "doc_id", "file", "at", "bytes", "n_tokens", "before"])
            at, before, rows = at + len(data), before + int(n.sum()), rows + len(n)
        if out:
            out.close()
    placed = docs.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    index = shelf.put(placed.mapInArrow(write, INDEX), "index")
    part = F.shiftright("place", 33)
    totals = index.groupBy(part.alias("part")).agg(F.sum("n_tokens").alias("n"))
    return index.withColumn("part", part).join(part_offsets(totals, "part", "n"), "part").select(
        "doc_id", (F.col("_before") + F.col("before")).alias("start"), "n_tokens", "file", "at", "bytes")


def _parsed(raw: bytes, size: np.ndarray, kind: str, name: str) -> list[np.ndarray]:
    """The ids of neighbouring records of these sizes; damage is an error."""
    data, ends = np.frombuffer(raw, np.uint8), np.cumsum(size)
    begins = ends - size
    if len(data) != ends[-1] or size.min() < FRAME:
        raise ValueError(f"a record of {name} is damaged")
    number = lambda place, width: data[place[:, None] + np.arange(width)].copy().view(f"<u{width}")[:, 0]
    sums = crc32c(data, np.append(np.stack([begins, begins + 8, begins + 12, ends - 4], 1).reshape(-1), len(data)))
    if (masked(sums[0::4]) != number(begins + 8, 4)).any() or (masked(sums[2::4]) != number(ends - 4, 4)).any() \
            or (number(begins, 8) != (size - FRAME).astype(np.uint64)).any():
        raise ValueError(f"a record of {name} is damaged")
    width = np.dtype(kind).itemsize
    return [np.frombuffer(raw, kind, n, a).astype("<u4") for a, n in zip((begins + 12).tolist(), ((size - FRAME) // width).tolist())]


def read_records(index: DataFrame, folder: str, kind: str, columns: str, emit) -> DataFrame:
    """Read the records that the index names, in any order, check both checksums of each, and ``emit`` rows.

    ``emit(batch, ids)`` gets rows of the index and the ids of each as uint32 arrays.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pa.fs.FileSystem.from_uri(folder)
        open_name, source = None, None
        for b in batches:
            file, at = b.column("file").dictionary_encode(), b.column("at").to_numpy()
            size = b.column("bytes").to_numpy()
            number = file.indices.to_numpy()
            begin = 0
            while begin < b.num_rows:
                # A run of records that stand behind each other in one file.
                breaks = np.flatnonzero((np.diff(number[begin:]) != 0) | (at[begin + 1:] != (at + size)[begin:-1]))
                end = begin + 1 + (int(breaks[0]) if len(breaks) else b.num_rows - begin - 1)
                end = begin + max(1, int(np.searchsorted((at + size)[begin:end] - at[begin], READ, "right")))
                name = file.dictionary[int(number[begin])].as_py()
                if name != open_name:
                    open_name, source = name, system.open_input_file(f"{root}/{name}")
                ids = _parsed(source.read_at(int((at + size)[end - 1] - at[begin]), int(at[begin])), size[begin:end], kind, name)
                yield emit(b.slice(begin, end - begin), ids)
                begin = end
    return index.mapInArrow(read, columns)


def _digest(b: pa.RecordBatch, ids: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        b.column(0), b.column(1), pa.array(np.fromiter(map(len, ids), np.int64, len(ids))),
        pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def record_digests(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each text as read back from the record files.

    Texts stand in ascending doc_id order (null first; rows with one doc_id by text). A null text is empty:
    it holds the end id alone. Files and index go to the shared folder. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    shelf = Shelf(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = write_records(rows, [F.col("doc_id"), F.crc32(F.coalesce("text", F.lit("")))], f"{shelf.root}/records", tokenizer, end, shelf)
    return read_records(index, f"{shelf.root}/records", str(encoder(tokenizer, end).kind.str),
                        "doc_id long, start long, n_tokens long, ids_crc32 long", _digest)
