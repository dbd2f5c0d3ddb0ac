"""Vectorised word kernel shared by the operators of this package.

A word is a maximal run of ``[0-9a-z]`` and non-ASCII characters of the lower-cased text; in SQL
``regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+')``.  Words are handled as 64-bit hashes:
a polynomial over the bytes, taken from prefix sums modulo 2**64, then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD_BYTE = np.array([chr(i) in "0123456789abcdefghijklmnopqrstuvwxyz" or i >= 128 for i in range(256)])
WORD_SQL = "[0-9a-z\\x{80}-\\x{10FFFF}]+"
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 64)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            out = np.multiply.accumulate(out)
        if n > BLOCK + 64:  # one huge word: not kept
            return out
        _powers[name] = have = out
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place on a uint64 array."""
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def utf8(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(texts) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return utf8(pc.utf8_lower(texts.cast(pa.large_string())))


class Words:
    """Words of a batch: hash, byte range in ``data``, and ``first[i]:first[i+1]`` for document i."""

    __slots__ = ("data", "end", "first", "hash", "offsets", "start")

    def __init__(self, texts):
        self.data, self.offsets = lowered(texts)
        n = len(self.data)
        word = np.zeros(n + 2, bool)
        word[1:-1] = _WORD_BYTE[self.data]
        edge = word[1:] != word[:-1]  # edge[i]: byte i differs from byte i-1
        inner = self.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        split = np.unique(inner[word[inner] & word[inner + 1]])  # a document ends inside a run
        marks = np.flatnonzero(edge)
        if len(split):
            marks = np.sort(np.concatenate([marks, split, split]))
        self.start, self.end = marks[0::2], marks[1::2]
        self.first = np.searchsorted(self.start, self.offsets, "left")
        self.hash = np.empty(len(self.start), np.uint64)
        a = 0
        while a < len(self.start):
            at = self.start[a]
            b = max(a + 1, int(np.searchsorted(self.end, at + BLOCK, "right")))
            self._fill(a, b)
            a = b

    def _fill(self, a: int, b: int) -> None:
        lo, hi = int(self.start[a]), int(self.end[b - 1])
        with np.errstate(over="ignore"):
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((self.data[lo:hi].astype(np.uint64) + np.uint64(1)) * _power("up", _R, hi - lo)[: hi - lo], out=total[1:])
            s, e = self.start[a:b] - lo, self.end[a:b] - lo
            self.hash[a:b] = mix((total[e] - total[s]) * _power("down", _R_INV, hi - lo + 1)[s])

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes of single words, as ``Words`` gives them."""
    return Words(pa.array([" ".join(words)])).hash if words else np.zeros(0, np.uint64)


def release() -> None:
    """Give freed memory back to the system, as a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def blocks(batches, column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each part has about ``most`` bytes of text, or one row; at the end memory is released."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        size = pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    release()
