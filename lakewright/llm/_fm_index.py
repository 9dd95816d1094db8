"""A compressed full-text index over integer words: BWT in a wavelet matrix.

Suffixes need only be in order to the depth that is searched, so they are sorted by
prefix doubling to 32 words.  The Burrows-Wheeler transform is held as one packed
bit vector per bit of a word code, with popcounts every 64 bits; the borders between
suffixes that differ within the depth are one more such vector.  Of the suffix array only the
least place of each such class is kept; the array itself lives while the index is built.
"""

from __future__ import annotations

import numpy as np

from lakewright.llm._words import U

DEPTH = 20
_SORTED = (1, 2, 4, 8, 16)


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(U)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)]).astype(np.int32)
        self.zeros = n - int(self.before[-1])

    def rank(self, p: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = p >> 6
        low = (U(1) << (p & 63).astype(U)) - U(1)
        return self.before[block] + np.bitwise_count(self.words[block] & low)


class FMIndex:
    """Index of a text of codes >= 1; 0 separates passages."""

    def __init__(self, text: np.ndarray, depth: int = DEPTH) -> None:
        n, self.depth = len(text), depth
        rank = text.astype(np.int64)
        by_length = {1: rank}
        for h in _SORTED:
            after = np.zeros(n, dtype=np.int64)
            after[: max(0, n - h)] = by_length[h][h:]
            key = by_length[h] * (int(by_length[h].max(initial=0)) + 1) + after
            by_length[2 * h] = np.unique(key, return_inverse=True)[1] + 1
        self.size, suffixes = n, np.argsort(by_length[32], kind="stable")
        # Classes of suffixes that agree in their first `depth` words are neighbours in the order.
        of, rest, at = np.zeros(n, dtype=np.int64), depth, 0
        for h in (16, 8, 4, 2, 1):
            if rest >= h:
                part = np.zeros(n, dtype=np.int64)
                part[: max(0, n - at)] = by_length[h][at:]
                of = np.unique(of * (int(part.max(initial=0)) + 1) + part, return_inverse=True)[1]
                rest, at = rest - h, at + h
        ordered = of[suffixes]
        new = np.ones(n, dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        starts = np.flatnonzero(new)
        self.borders, self.class_start = Bits(new), np.append(starts, n).astype(np.int32)
        self.least = (np.minimum.reduceat(suffixes, starts) if n else starts).astype(np.int32)
        bwt = text[suffixes - 1].astype(np.int64)  # the text starts with a separator
        self.levels = max(1, int(text.max(initial=1)).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.levels))])
        self.matrix = []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level) & 1
            self.matrix.append(Bits(bit))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        codes = np.arange(1 << self.levels)
        self.bottom = self._down(codes, np.zeros(len(codes), dtype=np.int64))

    def _down(self, code: np.ndarray, p: np.ndarray) -> np.ndarray:
        for i, bits in enumerate(self.matrix):
            ones = bits.rank(p)
            p = np.where((code >> (self.levels - 1 - i)) & 1, bits.zeros + ones, p - ones)
        return p

    def extend(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward-search step: the suffix ranges of code followed by the old patterns."""
        base = self.first[code] - self.bottom[code]
        return base + self._down(code, lo), base + self._down(code, hi)

    def shrink(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of all suffixes that agree with suffix lo in `depth` words."""
        c = self.number(lo)
        return self.class_start[c], self.class_start[c + 1]

    def number(self, p: np.ndarray) -> np.ndarray:
        """The class of the suffix at each place of the order."""
        return self.borders.rank(p + 1) - 1

    @property
    def n_bytes(self) -> int:
        """Bytes the index holds."""
        return sum(b.words.nbytes + b.before.nbytes for b in [*self.matrix, self.borders]) + sum(a.nbytes for a in (self.class_start, self.least, self.first, self.bottom))


def matching_statistics(index: FMIndex, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For every position of the passages text[start : start + size], streamed backwards
    and in step: the first position in the index of the `depth` words from there,
    or -1 where fewer are left or the index has no such words."""
    out = np.full(len(text), -1, dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    n = index.size
    lo, hi = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), n, dtype=np.int64)
    length = np.zeros(len(starts), dtype=np.int64)
    live = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left")
    for step, m in enumerate(live):
        at = starts[:m] + sizes[:m] - 1 - step
        a, b = index.extend(text[at], lo[:m], hi[:m])
        # No occurrence: start again with nothing matched.
        none = a >= b
        grown = np.where(none, 0, length[:m] + 1)
        a, b = np.where(none, 0, a), np.where(none, n, b)
        deep = np.flatnonzero(grown >= index.depth)
        if len(deep):
            a[deep], b[deep] = index.shrink(a[deep])
            grown[deep] = index.depth
            out[at[deep]] = index.least[index.number(a[deep])]
        lo[:m], hi[:m], length[:m] = a, b, grown
    return out
