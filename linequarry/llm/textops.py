"""Vectorised tokenising and hashing of Arrow string columns (numpy, whole texts).

A *word* is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D`` after
A-Z is lower-cased; every other byte is kept, so multi-byte characters stay
inside their word.  Word hashes are 64-bit polynomial hashes over randomised
byte values, finished with an avalanche step; a chunk of many documents is
hashed with a handful of numpy passes and no Python loop per word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x):
    """Avalanche a uint64 array (returns a new array)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def random_u64(n: int, seed: int):
    """n reproducible uint64 values."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1)


BYTE_VALUE = random_u64(256, 11)[LOWER]


class Words(NamedTuple):
    hash: np.ndarray  # uint64 per word
    doc: np.ndarray  # int64 index of the word's document in the chunk
    start: np.ndarray  # byte offsets into the chunk
    end: np.ndarray
    first: np.ndarray  # n_docs + 1 word offsets


def string_buffers(arr):
    """(bytes, offsets) of a string or binary array; nulls become empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    if len(arr) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(arr, limit: int = 1 << 19):
    """Yield (first row, end row, bytes, offsets) of about ``limit`` bytes; a text is never cut."""
    data, offsets = string_buffers(arr)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def powers(n: int, base: int = _BASE):
    p = np.full(max(n, 1), base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class Tokenizer:
    """Keeps the power tables between chunks."""

    PIECE = 1 << 21

    def __init__(self):
        self.up = powers(1 << 19)
        self.down = powers(1 << 19, _INV)

    def _grow(self, n):
        if n > len(self.up):
            self.up, self.down = powers(n + n // 4), powers(n + n // 4, _INV)

    def words(self, buf, offsets) -> Words:
        """Words of one chunk; a chunk over PIECE bytes is worked off piecewise, cut at white space."""
        n_docs = len(offsets) - 1
        if len(buf) <= self.PIECE:
            h, s, e = self._piece(buf, offsets)
        else:
            parts, a = [], 0
            while a < len(buf):
                b = min(len(buf), a + self.PIECE)
                if b < len(buf):
                    back = np.flatnonzero(SPACE[buf[a:b]])
                    if len(back):
                        b = a + int(back[-1]) + 1
                    else:
                        ahead = np.flatnonzero(SPACE[buf[b:]])
                        b = b + int(ahead[0]) + 1 if len(ahead) else len(buf)
                        later = offsets[(offsets > a) & (offsets < b)]
                        b = int(later[0]) if len(later) else b
                inner = offsets[(offsets > a) & (offsets < b)]
                h, s, e = self._piece(buf[a:b], np.concatenate([[0], inner - a, [b - a]]))
                parts.append((h, s + a, e + a))
                a = b
            h, s, e = (np.concatenate(x) for x in zip(*parts))
        doc = np.searchsorted(offsets, s, "right") - 1
        first = np.searchsorted(s, offsets, "left")
        return Words(h, doc, s, e, first if len(first) == n_docs + 1 else np.zeros(n_docs + 1, np.int64))

    def _piece(self, buf, offsets):
        n = len(buf)
        if n == 0:
            z = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), z, z
        self._grow(n + 1)
        solid = ~SPACE[buf]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        before = np.empty(n, bool)
        before[0], before[1:] = False, solid[:-1]
        before[cut] = False
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, solid[1:]
        after[cut - 1] = False
        s = np.flatnonzero(solid & ~before)
        e = np.flatnonzero(solid & ~after) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUE[buf] * self.up[:n], out=total[1:])
        return mix64((total[e] - total[s]) * self.down[s]), s, e


_SHINGLE = random_u64(64, 23)


def shingle_hashes(words: Words, width: int):
    """(hash, doc) of every run of ``width`` words; a document with fewer (but some) words gives its whole sequence as one."""
    n = len(words.hash)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = n - width + 1
    if m > 0:
        whole = words.doc[:m] == words.doc[width - 1 :]
        h = np.zeros(m, np.uint64)
        for k in range(width):
            h += words.hash[k : k + m] * _SHINGLE[k]
        h, d = mix64(h[whole]), words.doc[:m][whole]
    else:
        h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            extra[has] += words.hash[words.first[short][has] + k] * _SHINGLE[k]
        # the length keeps a short sequence apart from a full shingle
        h = np.concatenate([h, mix64(extra + counts[short].astype(np.uint64) * _SHINGLE[63])])
        d = np.concatenate([d, short])
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d


def distinct_sets(h, d, n_docs: int):
    """Sorted distinct hashes of each document: (hashes, offsets), documents one after another."""
    bounds = np.searchsorted(d, np.arange(n_docs + 1))
    out, sizes = [], np.zeros(n_docs + 1, np.int64)
    for k in range(n_docs):
        x = np.sort(h[bounds[k] : bounds[k + 1]])
        if len(x) > 1:
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            x = x[keep]
        out.append(x)
        sizes[k + 1] = len(x)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary column whose rows are slices of ``data`` (element offsets)."""
    raw = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])
