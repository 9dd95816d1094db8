"""Vectorised word handling over Arrow string buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D, exactly the
pattern ``[^\\x20\\x09-\\x0D]+`` over code points, since UTF-8 continuation
bytes never fall in that set.  Everything here works on whole texts; batches
are only cut between rows, so memory is bounded by a slice plus one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_NGRAM = U(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_IS_WORD = ~_SPACE


def _inverse(odd: int) -> U:
    return U(pow(odd, -1, 1 << 64))


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, grown on demand."""

    def __init__(self, base: U) -> None:
        self.base, self.inv = base, _inverse(int(base))
        self.up = np.ones(1, dtype=U)
        self.down = np.ones(1, dtype=U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inv)):
                p = np.full(size, b, dtype=U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


_NGRAM_POWERS = _Powers(_NGRAM)

#: Words of more bytes than this are hashed one by one.
_WIDE = 64
_KEY = b"words of documents"


def _keys(name: str) -> np.ndarray:
    """Drawn 64-bit keys: one for a word's length and one for each of its 4-byte lanes."""
    return np.frombuffer(b"".join(hashlib.blake2b(f"{name} {i}".encode(), key=_KEY, digest_size=8).digest() for i in range(_WIDE // 4 + 1)), dtype="<u8").astype(U)


_LANE_KEYS = _keys("high"), _keys("low")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply, the constants of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64 [rows + 1], bytes) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(offs, dtype=np.int64, count=n + 1, offset=8 * column.offset)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def slices(column, max_bytes: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column between rows into (first, last + 1, offsets, bytes) of about max_bytes."""
    offsets, data = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        lo = hi


def tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each row's first word (rows + 1)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(offsets), dtype=np.int64)
    word = _IS_WORD[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    start[cut] = word[cut]
    end[cut - 1] = word[cut - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word.

    Of words up to 64 bytes the upper halves of two sums of products of 4-byte lanes with drawn
    keys, a universal hash: words that differ agree with a probability of 2**-64 over the keys, whatever
    the words.  Longer words take a keyed BLAKE2 digest.
    """
    size = ends - starts
    if not len(starts):
        return np.zeros(0, dtype=U)
    padded = np.concatenate([data, np.zeros(4, dtype=np.uint8)])
    lanes = np.ndarray((len(data) + 1,), dtype="<u4", buffer=padded, strides=(1,))
    high, low = (size.astype(U) * k[0] for k in _LANE_KEYS)
    live, at, left = slice(None), starts, size
    for j in range(_WIDE // 4):
        lane = lanes[at].astype(U)
        part = left < 4
        lane[part] &= (U(1) << (left[part].astype(U) << U(3))) - U(1)
        high[live] += lane * _LANE_KEYS[0][j + 1]
        low[live] += lane * _LANE_KEYS[1][j + 1]
        more = np.flatnonzero(left > 4)
        if not len(more):
            break
        live = more if j == 0 else live[more]
        at, left = at[more] + 4, left[more] - 4
    for i in np.flatnonzero(size > _WIDE):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), key=_KEY, digest_size=16).digest()
        high[i], low[i] = np.frombuffer(digest, dtype="<u8")
    return mix((high & U(0xFFFFFFFF00000000)) | (low >> U(32)))


def ngrams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k consecutive words within a row: (index of the first word, hash, row bounds)."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], counts)
    up, down = _NGRAM_POWERS.get(len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=U)
    np.cumsum(h * up[:-1], out=total[1:])
    return at, mix((total[at + k] - total[at]) * down[at] + U(k)), bounds
