"""Scans of UTF-8 text columns with numpy: words, lines, shingles and their 64-bit hashes.

Everything works on the buffers of whole Arrow batches, cut into pieces of bounded size, so that the
cost is a few array operations for each byte and never a Python call for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 256 << 10  # bytes of text handled at once, so that arrays stay small and in the cache; a longer single text makes a piece of its own

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240531))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
OTHER_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {way: np.ones(1, np.uint64) for way in ("up", "down", "seed")}


def power(way: str, n: int) -> np.ndarray:
    """The first n powers of the base ("up", "seed") or of its inverse ("down"), modulo 2**64."""
    if len(_powers[way]) < n:
        one = np.full(n if way == "seed" else max(n, PIECE + 1), BASE_INVERSE if way == "down" else BASE, np.uint64)
        one[0] = 1
        _powers[way] = np.multiply.accumulate(one)
    return _powers[way][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the len + 1 offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.view(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(at, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64) \
        if at is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    first, last = (offsets[0], offsets[-1]) if len(offsets) else (0, 0)
    raw = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(at, at[begin] + most, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of all words, and for each text the number of words before it (len + 1)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    solid = ~SPACE[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    cut = at[1:-1]
    inner = cut[(cut > 0) & (cut < len(data))]
    begin[inner] = solid[inner]
    end[inner - 1] = solid[inner - 1]
    begins = np.flatnonzero(begin)
    return begins, np.flatnonzero(end) + 1, np.searchsorted(begins, at)


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of all lines between line feeds, and for each text the number of lines before it.

    A text has one line more than line feeds, so an empty one has an empty line.
    """
    feeds = np.flatnonzero(data == 10)
    count = np.searchsorted(feeds, at[1:]) - np.searchsorted(feeds, at[:-1]) + 1
    before = np.concatenate(([0], np.cumsum(count)))
    begin, end = np.empty(before[-1], np.int64), np.empty(before[-1], np.int64)
    inner = np.ones(before[-1], bool)
    inner[before[:-1]] = False
    begin[before[:-1]], begin[inner] = at[:-1], feeds + 1
    inner[:] = True
    inner[before[1:] - 1] = False
    end[before[1:] - 1], end[inner] = at[1:], feeds
    return begin, end, before


def stripped(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without white space at both ends; a blank one becomes empty at its begin."""
    solid = np.flatnonzero(~SPACE[data])
    i, j = np.searchsorted(solid, begin), np.searchsorted(solid, end)
    some = j > i
    first, last = begin.copy(), begin.copy()
    first[some], last[some] = solid[i[some]], solid[j[some] - 1] + 1
    return first, last


def prefix_hash(data: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """Running polynomial hash, one value more than bytes; a span's hash comes from two of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * power("up", len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each byte span: equal bytes give equal values wherever they stand."""
    raw = (prefix[end] - prefix[begin]) * power("down", len(prefix))[begin]
    return mix(raw + np.uint64(seed) + (end - begin).astype(np.uint64) * PLACE[63])


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased) and for each text the number of words before it."""
    begin, end, before = spans(data, at)
    return span_hash(prefix_hash(LOWER[data] if lower else data), begin, end), before


def shingles(words: np.ndarray, before: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text; a shorter text is one shingle, an empty one none."""
    sets: list[np.ndarray] = []
    n = len(words)
    runs = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        runs += words[j:n - k + 1 + j] * PLACE[j] if n >= k else runs
    runs = mix(runs)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= k:
            own = np.sort(runs[a:b - k + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            sets.append(own)
        elif b > a:
            sets.append(mix((words[a:b] * PLACE[8:8 + b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All sets behind each other, and for every element the number of its set."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.repeat(np.arange(len(sets)), sizes)


def fast_sketch(sets: list[np.ndarray], t: int = 128) -> np.ndarray:
    """Fast similarity sketches, one row of t values for each set.

    Round i < t throws every element into a hashed bin and keeps the least (round, hash) of each bin;
    rounds t to 2t - 1 aim all elements at bin i - t, so every bin of a set with an element is filled.
    Sets drop out of the rounds when their bins are full. Equal bins estimate the Jaccard similarity.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), t), full)
    elements, owner = joined(sets)
    for i in range(2 * t):
        if not len(elements):
            break
        h = mix(elements + power("seed", 2 * t)[i])
        value = (h >> np.uint64(34)) | (np.uint64(i) << np.uint64(32))
        slot = owner * t + ((h & np.uint64(0xFFFFFFFF)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) \
            if i < t else owner * t + (i - t)
        np.minimum.at(out.reshape(-1), slot, value)
        left = (out == full).any(axis=1)
        keep = left[owner]
        if not keep.all():
            elements, owner = elements[keep], owner[keep]
    return out
