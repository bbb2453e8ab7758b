"""Vectorised word segmentation and hashing over Arrow string columns.

Texts of a batch stay in their Arrow UTF-8 buffer; words are found with byte
tables and hashed with NumPy, so no per-word Python object is made.  A null
text counts as empty.  Work arrays are a fixed multiple of ``SLICE`` bytes,
whatever the batch holds (a longer single text gets a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 2 << 20
U64 = np.uint64

#: ASCII A-Z folded to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: True where a byte separates words `[^\x20\x09-\x0D]+`.
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True

#: True where a byte separates words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (of folded text).
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[0:48] = NOT_ALNUM[58:97] = NOT_ALNUM[123:128] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix constants), for arrays."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, dtype=U64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        step = np.full(max(n, 256), _BASE, dtype=U64)
        step[0] = 1
        _powers = np.multiply.accumulate(step)
    return _powers


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``column``."""
    for b in batches:
        size = np.diff(utf8(b.column(column))[0])
        part = np.cumsum(size, dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            if j > i:
                yield b.slice(i, j - i)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; the first offset is 0."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    if not len(texts):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, dtype=wide)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return off - off[0], raw[off[0]:off[-1]]


class Words:
    """Words of a slice of texts: byte ranges in ``low`` (folded bytes) and, for
    text d, the word numbers ``first[d]:first[d + 1]``."""

    def __init__(self, texts: pa.Array, separators: np.ndarray):
        off, raw = utf8(texts)
        self.off, self.raw, self.low = off, raw, LOWER[raw]
        inside = ~separators[self.low]
        begin, finish = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        finish[:-1] &= ~inside[1:]
        full = off[1:] > off[:-1]
        begin[off[:-1][full]] = inside[off[:-1][full]]
        finish[off[1:][full] - 1] = inside[off[1:][full] - 1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, off)
        self._inside = inside

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word's folded bytes."""
        lens = self.ends - self.starts
        out = np.empty(len(lens), dtype=U64)
        if not len(lens):
            return out
        chars = self.low[self._inside]
        at = np.concatenate([[0], np.cumsum(lens)])
        power = _power(int(lens.max()))
        cuts = [0]
        while cuts[-1] < len(lens):
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(at, at[cuts[-1]] + SLICE, side="right")) - 1))
        for i, j in zip(cuts, cuts[1:]):
            place = np.arange(at[i], at[j]) - np.repeat(at[i:j], lens[i:j])
            value = _BYTE[chars[at[i]:at[j]]]
            value *= power[place]
            out[i:j] = np.add.reduceat(value, at[i:j] - at[i])
        return mix64(out ^ (lens.astype(U64) * U64(0xD6E8FEB86659FD93)))

    def word(self, i: int) -> str:
        return self.low[self.starts[i]:self.ends[i]].tobytes().decode("utf-8")


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes ``Words.hashes`` gives these words (already folded, no separators in them)."""
    return Words(pa.array(words, pa.string()), np.zeros(256, dtype=bool)).hashes()
